"""Patterns, addresses, the expression grammar and aliases."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from entrywise.functions.patterns import UsageError, glob_regex, parse_fid, parse_mode, size_unit
from entrywise.plans.ast import Always, And, Cmp, Not, Or
from entrywise.plans.parser import expand_aliases, parse
from entrywise.plans.predicates import Context, parse_level
from entrywise.plans.report import parse_group_by, parse_output
from entrywise.sources.uri import Uri, parse_uri

CTX = Context(now=10_000_000, users={"ann": 7}, groups={"staff": 3})


@pytest.mark.parametrize(
    ("glob", "text", "fits"),
    [("*.c", "a.c", True), ("*.c", "a.cc", False), ("a?c", "abc", True), ("[!a]b", "ab", False), ("[a-c]x", "bx", True), (r"\*", "*", True), ("a.b", "axb", False), ("*", "a\nb", True), ("ab", "ab\n", False), ("[", "[", True), ("a{1}", "a{1}", True)],
)
def test_globs(glob, text, fits):
    assert bool(re.search("(?s)" + glob_regex(glob), text)) == fits


@given(st.text(alphabet="ab.*?[]\\(){}^$+|", max_size=8))
def test_globs_always_compile(text):
    re.compile(glob_regex(text))


@pytest.mark.parametrize(("text", "mode"), [("644", 0o644), ("u=rw,go=r", 0o644), ("a+x", 0o111), ("u+s", 0o4000), ("+t", 0o1000), ("u=rwx,g=u,o=g", 0o777), ("g+s,u=rwx", 0o2700), ("u=rwx,u-w", 0o500), ("u=x,go+X", 0o111)])
def test_modes(text, mode):
    assert parse_mode(text) == mode


@pytest.mark.parametrize("text", ["8", "77777", "u~r", "", "u=q"])
def test_bad_modes(text):
    with pytest.raises(UsageError):
        parse_mode(text)


def test_sizes():
    assert size_unit("3") == (3, 512) and size_unit("2w") == (2, 2) and size_unit("1T") == (1, 1 << 40)
    with pytest.raises(UsageError):
        size_unit("1x")


def test_size_predicates():
    f = lambda a: parse(["-size", a], CTX).filter
    assert f("+1k") == Cmp(">", "statx.size", 1024)
    assert f("-1M") == Cmp("<=", "statx.size", 0)
    assert f("-0") == Cmp("<=", "statx.size", 0)
    assert f("1k") == And((Cmp(">", "statx.size", 0), Cmp("<", "statx.size", 1025)))


def test_time_predicates():
    day = 86_400
    assert parse(["-mtime", "+2"], CTX).filter == Cmp("<", "statx.mtime", CTX.now - 2 * day)
    assert parse(["-mmin", "5"], CTX).filter == And((Cmp(">", "statx.mtime", CTX.now - 360), Cmp("<", "statx.mtime", CTX.now - 300)))


@pytest.mark.parametrize("args", ["-o -type f", "-type f -o", "( -type f", "( )", "-type x", "-type", "-nosuch", "-type f entrywise:mongo:x", "-user bob", "-limit 1 -limit 2", "-prune", "-true", "-a -type f", "! -print", "-sort nothing", "-size q", ")"])
def test_usage_errors(args):
    with pytest.raises(UsageError):
        parse(args.split(), CTX)


def test_grammar():
    a, b, c = Cmp("=", "statx.uid", 1), Cmp("=", "statx.uid", 2), Cmp("=", "statx.uid", 3)
    assert parse([], CTX).filter == Always()
    assert parse("-uid 1 -uid 2 -o -uid 3".split(), CTX).filter == Or((And((a, b)), c))
    assert parse("-uid 1 ( -uid 2 -o -uid 3 )".split(), CTX).filter == And((a, Or((b, c))))
    assert parse("! ! -uid 1".split(), CTX).filter == Not(Not(a))
    q = parse("-uid 1 -print -o -uid 2 -count".split(), CTX)
    assert [x.name for x in q.actions] == ["-print", "-count"]
    assert q.actions[0].filter == a and q.actions[1].filter == And((Not(a), b))
    assert parse("-exec rm {} ; -uid 1".split(), CTX).actions[0].args == ("rm", "{}")


def test_aliases():
    table = {"big": ["-size", "+1G"], "old": ["-mtime", "+9"], "both": ["--alias", "big,old"], "loop": ["--alias", "again"], "again": ["--alias", "loop"]}
    assert expand_aliases(["--alias", "both", "-print"], table) == ["-size", "+1G", "-mtime", "+9", "-print"]
    for bad in (["--alias", "loop"], ["--alias", "none"], ["--alias"]):
        with pytest.raises(UsageError):
            expand_aliases(bad, table)


def test_uris():
    assert parse_uri("entrywise:mongo:a%20b#x/y") == Uri("mongo", "a b", "x/y")
    assert parse_uri("entrywise:mongo:t#[0x1:0x2:0x3]").id == (1).to_bytes(8, "little") + (2).to_bytes(4, "little") + (3).to_bytes(4, "little")
    assert parse_uri("entrywise:posix:/mnt") == Uri("posix", "/mnt")
    for bad in ("mongo:x", "entrywise:mongo:", "entrywise::x", "entrywise:mongo:a%zz"):
        with pytest.raises(UsageError):
            parse_uri(bad)


def test_fids_and_levels():
    assert parse_fid("0x1:0x2:0x0") == parse_fid("[0x1:0x2:0x0]")
    assert parse_level("s2:c1,c3.c5") == (2, [(1, 1), (3, 5)])
    for bad in ("2", "s1:c5.c3", "s1:d"):
        with pytest.raises(UsageError):
            parse_level(bad)


def test_report_arguments():
    assert [o.name for o in parse_output("avg(statx.size),count()")] == ["result_avg_statx_size", "result_count"]
    assert parse_group_by("statx.uid,statx.size[0;5]")[1].bounds == (0, 5)
    for bad in ("avg(statx.size", "statx.size", "avg()", "median(statx.size)", "count(statx.size)", "avg(nope)"):
        with pytest.raises(UsageError):
            parse_output(bad)
    for bad in ("nope", "statx.size[5;0]", "statx.size[a]"):
        with pytest.raises(UsageError):
            parse_group_by(bad)


def test_config(tmp_path, monkeypatch):
    from entrywise.sources.config import Config

    monkeypatch.setenv("WHERE", "/mnt")
    f = tmp_path / "c.json"
    f.write_text('{"alias": {"big": "-size +1G"}, "a": {"b.c": 1, "b": {"d": "${WHERE}/x"}}, "backends": {"lus": {"extends": "posix", "enrichers": ["lustre"]}, "keep": {"extends": "lus", "enrichers": ["retention"], "iterator": "mfu"}, "x": {"extends": "y"}, "y": {"extends": "x"}}}')
    c = Config.load(str(f))
    assert c.get("a.b.c") == 1 and c.get("a.b.d") == "/mnt/x" and c.get("a.z", 5) == 5
    assert c.backend("keep") == {"plugin": "posix", "extends": "lus", "enrichers": ["lustre", "retention"], "iterator": "mfu"}
    assert c.aliases() == {"big": ["-size", "+1G"]}
    for bad in ("x", "none"):
        with pytest.raises(UsageError):
            c.backend(bad)
