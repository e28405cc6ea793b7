"""Golden cases, folds, streams, policies, scans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entrywise.functions.patterns import UsageError
from entrywise.operators import maintenance, policy, tree
from entrywise.plans import find, registry, report
from entrywise.plans.parser import parse
from entrywise.plans.ast import And, Cmp
from entrywise.plans.predicates import Context
from entrywise.sources import objects, sync
from entrywise.sources import scan as scanner
from entrywise.streaming import changelog, enrich, events, fold, stream

FILE, DIR = 0o100000, 0o040000


def entries(spark, sizes, root=100):
    rows = [(1, 0, "", "/", DIR, root, 1)] + [(k + 2, 1, n, "/" + n, FILE, s, k + 2) for k, (n, s) in enumerate(sizes.items())]
    return spark.createDataFrame(rows, "id long, parent_id long, name string, path string, type int, size long, ino long").withColumn("mtime_sec", F.lit(2).cast("long"))


def names(df):
    return [r["path"] for r in df.collect()]


def test_size_cases(spark):
    e = entries(spark, {"empty": 0, "1K": 1024, "1K+1": 1025, "1M": 1 << 20})
    run = lambda a: sorted(names(find.find(e, a.split())))
    assert run("-size 1k") == ["/", "/1K"]
    assert run("-size +1k") == ["/1K+1", "/1M"]
    assert run("-size +1k -size -1M") == []
    assert run("-size -1M") == ["/empty"]


def test_sort_cases(spark):
    e = entries(spark, {"file1": 5, "file2": 7, "file3": 10})
    assert names(find.find(e, "-sort size".split())) == ["/file1", "/file2", "/file3", "/"]
    assert names(find.find(e, "-rsort size".split())) == ["/", "/file3", "/file2", "/file1"]
    tie = entries(spark, {"file1": 5, "file2": 5, "file3": 10})
    assert names(find.find(tie, "-sort size -rsort ino".split()))[:2] == ["/file2", "/file1"]


def test_report_cases(spark):
    e = entries(spark, {f"a{k}": 5 for k in range(3)} | {f"b{k}": 50 for k in range(3)}, root=40)
    assert report.csv_lines(e, "statx.size[0;30]", "sum(statx.size)") == ["[0; 30]: 15", "[30; +inf]: 190"]
    assert report.csv_lines(e, "statx.type", "sum(statx.size)") == ["directory: 40", "file: 165"]
    assert report.csv_lines(e, None, "sum(statx.size)", parse("-type f -a -type d".split()).filter) == []
    assert report.csv_lines(e, None, "sum(statx.size)", parse("-type f -o -type d".split()).filter) == ["205"]
    assert report.csv_lines(e, "statx.type", "count()", descending=True)[0].startswith("file")
    assert "sum(statx.size)" in report.pretty(e, "statx.type", "sum(statx.size)")
    with pytest.raises(UsageError):
        report.report(e, None, "count()", parse(["-newer", "/gone"]).filter)


def test_run_prints_in_order_of_actions(spark):
    e = entries(spark, {"a": 5, "b": 7})
    assert list(find.run(e, r"-type f -sort size -printf %f=%s\n".split())) == ["a=5\n", "b=7\n"]
    assert list(find.run(e, "-type f -count".split())) == ["2 matching entries"]
    done = []
    assert list(find.run(e, "-name b -exec echo {} ;".split(), execute=done.append)) == [] and done == [["echo", "/b"]]
    with pytest.raises(UsageError):
        parse(["-printf", "%Q"]) and list(find.run(e, ["-printf", "%Q"]))


def log(spark, *made):
    """Events from dictionaries; statx fields are given beside the others."""
    rows = []
    for k, e in enumerate(made):
        e = {"seq": k, **e}
        statx = {c: e.pop(c) for c in list(e) if c in events.STATX and c != "type"}
        e["statx"] = {c: statx.get(c) for c in events.STATX} if statx else None
        rows.append(tuple(e.get(c) for c in events.FIELDS))
    return spark.createDataFrame(rows, events.SCHEMA)


def test_fold_cases(spark):
    """Each case is an id of one log."""
    link, up = dict(type="LINK", parent_id=9, name="a"), lambda **k: dict(type="UPSERT", **k)
    unlink, gone = {**link, "type": "UNLINK"}, dict(type="DELETE")
    x = lambda op, v, **more: dict(type="XATTR", key="k", op=op, value=v, **more)
    stamped = lambda v, t, f: x("set", v, stamp=t, final=f)
    values = [
        ([x("inc", "2"), x("inc", "3")], "5"), ([x("set", "7"), x("inc", "1")], "8"), ([x("inc", "1"), x("set", "7")], "7"), ([x("set", "7"), x("unset", None)], None), ([x("unset", None), x("inc", "4")], "4"),
        ([x("set", '"text"')], '"text"'), ([x("set", "[1, 2]"), x("set", "true")], "true"), ([stamped("1", 5, False), stamped("2", 4, True)], "1"), ([stamped("1", 5, False), stamped("2", 5, False)], "2"),
        ([stamped("1", 5, True), stamped("2", 5, False), stamped("3", 5, True)], "1"), ([stamped("1", 5, True), stamped("2", 6, False), x("inc", "1")], "3"),
    ]
    inodes = [([link, up(size=4), gone], None), ([up(size=4), gone, up(uid=3)], (None, 3, None, None)), ([up(size=4, uid=1), up(size=6, mode=7), up(symlink="x")], (6, 1, 7, "x"))]
    links = [([link, unlink], 0), ([unlink, link], 1)]
    cases = [events_ for events_, _ in values + inodes + links]
    m = fold.fold(log(spark, *[{**e, "id": k} for k, case in enumerate(cases) for e in case]))
    got = {r["id"]: r["value"] for r in m.xattrs.collect()}
    assert [got.get(k) for k in range(len(values))] == [v for _, v in values]
    first = len(values)
    got = {r["id"]: (r["size"], r["uid"], r["mode"], r["symlink"]) for r in m.inodes.collect()}
    assert [got.get(first + k) for k in range(len(inodes))] == [v for _, v in inodes]
    got = Counter(r["id"] for r in m.links.collect())
    assert [got[first + len(inodes) + k] for k in range(len(links))] == [v for _, v in links]


def test_partial_unlink_and_attributes_of_links(spark):
    link = dict(type="LINK", id=1, parent_id=9, name="a")
    path = dict(type="XATTR", id=1, ns=True, parent_id=9, name="a", key="path", op="set", value='"/d/a"')
    cut = dict(type="PARTIAL_UNLINK", id=1, rm_time=77)
    first, second = [link, path, cut], [dict(link, name="b"), dict(path, name="b", value='"/d/b"')]
    want_links = [(1, None, None, 77), (1, 9, "b", None)]
    want = [(True, None, None, '"/d/a"'), (True, 9, "b", '"/d/b"')]
    for cutting in (0, 4):
        all_ = [dict(e, seq=k) for k, e in enumerate(first + second)]
        m = fold.apply(stored(fold.fold(log(spark, *all_[:cutting]))), log(spark, *all_[cutting:]))
        assert sorted(map(tuple, m.links.collect()), key=repr) == sorted(want_links, key=repr)
        assert sorted([tuple(r[c] for c in ("ns", "parent_id", "name", "value")) for r in m.xattrs.collect()], key=repr) == sorted(want, key=repr)
    assert fold.fold(log(spark, link, path, dict(link, type="UNLINK"), link)).xattrs.count() == 0
    assert fold.fold(log(spark, path)).xattrs.count() == 0


def random_log(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        kind = rnd.choice(["UPSERT", "LINK", "LINK", "UNLINK", "XATTR", "XATTR", "XATTR", "DELETE", "PARTIAL_UNLINK"])
        e = dict(type=kind, id=rnd.randrange(3), seq=k)
        if kind == "UPSERT":
            e |= {rnd.choice(["size", "uid", "mode", "symlink"]): rnd.randrange(9)}
            e |= {"symlink": str(e["symlink"])} if "symlink" in e else {}
        elif kind == "XATTR":
            e |= dict(key=rnd.choice("pq"), op=rnd.choice(["set", "inc", "inc", "unset"]), value=str(rnd.randrange(9)))
            e |= dict(ns=True, parent_id=rnd.randrange(2), name=rnd.choice("ab")) if rnd.random() < 0.5 else {}
        elif kind == "PARTIAL_UNLINK":
            e |= dict(rm_time=k)
        elif kind != "DELETE":
            e |= dict(parent_id=rnd.randrange(2), name=rnd.choice("ab"))
        out.append(e)
    return out


def stored(m):
    return fold.Mirror(*(tree.keep(t) for t in (m.inodes, m.links, m.xattrs)))


def tables(m):
    return [sorted(map(tuple, t.collect()), key=repr) for t in (m.inodes, m.links, m.xattrs)]


@pytest.mark.parametrize("seed", [1])
def test_any_split_of_a_log_gives_the_same_mirror(spark, seed):
    made = random_log(seed)
    whole = tables(fold.fold(log(spark, *made)))
    cut = 17 + 20 * seed % 30
    parts = stored(fold.fold(log(spark, *made[:cut])))
    assert tables(fold.apply(parts, log(spark, *made[cut:]))) == whole
    assert tables(fold.fold(tree.keep(fold.compact(log(spark, *made))))) == whole


def links_log(ids, n=40):
    """Logs of many ids, rich in attributes of links and in partial unlinks, one event of each id in turn."""
    rnd, out = random.Random(4), []
    for seq in range(n * ids):
        e = dict(type=rnd.choice(["LINK", "LINK", "UNLINK", "PARTIAL_UNLINK", *["XATTR"] * 6]), id=seq % ids, seq=seq)
        e |= dict(rm_time=seq) if e["type"] == "PARTIAL_UNLINK" else dict(parent_id=1, name=rnd.choice("abc"))
        if e["type"] == "XATTR":
            e |= dict(ns=True, key=rnd.choice("pq"), op=rnd.choice(["set", "inc", "inc", "unset"]), value=rnd.choice(["1", "2", "30", '"x"']))
        out.append(e)
    return out


def plain_attributes(made):
    """(id, name, key): value of the attributes of links, by a loop over each id."""
    out = {}
    for i in {e["id"] for e in made}:
        there, moved = {}, []  # the attribute events that count: of the links, and of the row without a name
        for e in (e for e in made if e["id"] == i):
            name = e.get("name")
            if e["type"] == "LINK":
                there[name] = []
            elif e["type"] == "UNLINK":
                there.pop(name, None)
            elif e["type"] == "PARTIAL_UNLINK":
                moved, there = moved + [x for own in there.values() for x in own], {}
            elif name in there:
                there[name].append(e)
        for name, own in {**there, None: moved}.items():
            for e in sorted(own, key=lambda e: e["seq"]):
                at = i, name, e["key"]
                number = lambda v: int(v) if v and v.isdigit() else 0
                if e["op"] == "set":
                    out[at] = e["value"]
                elif e["op"] == "unset":
                    out.pop(at, None)
                elif e["value"].isdigit():
                    out[at] = str(number(out.get(at)) + number(e["value"]))
    return out


def test_attributes_of_links_moved_in_a_later_batch(spark):
    made = links_log(60)
    whole = fold.fold(log(spark, *made))
    want = plain_attributes(made)
    assert {(r["id"], r["name"], r["key"]): r["value"] for r in whole.xattrs.collect()} == want and sum(k[1] is None for k in want) > 40
    m = None
    for k in range(3):
        batch = log(spark, *made[800 * k : 800 * k + 800])
        m = stored(fold.fold(batch) if m is None else fold.apply(m, batch))
        assert {(r["id"], r["name"], r["key"]): r["value"] for r in m.xattrs.collect()} == plain_attributes(made[: 800 * k + 800])
    assert tables(m) == tables(whole)
    assert tables(fold.fold(tree.keep(fold.compact(log(spark, *made))))) == tables(whole)


def test_parts_are_kept_where_they_matter(spark):
    link = lambda n: dict(type="LINK", parent_id=1, name=n)
    x = lambda op, v, n: dict(type="XATTR", ns=True, key="k", op=op, value=v, parent_id=1, name=n)
    cases = [
        [link("a"), x("set", "5", "a")], [link("a"), x("set", "5", "a"), x("inc", "1", "a")], [link("a"), link("b"), x("set", "5", "a"), x("unset", None, "b")],
        [link("a"), link("b"), x("unset", None, "b"), x("set", "5", "a")], [dict(type="XATTR", key="k", op="inc", value="2")], [link("a"), link("b"), x("inc", "5", "a"), x("inc", "7", "a"), x("set", "1", "b")],
    ]
    m = fold.fold(log(spark, *[{**e, "id": k} for k, case in enumerate(cases) for e in case]))
    got = {(r["id"], r["name"]): r["parts"] and [(p["seq"], p["name"], p["op"], p["value"]) for p in r["parts"]] for r in m.xattrs.collect()}
    assert got == {
        (0, "a"): None, (1, "a"): [(-2, "a", "set", "5"), (-1, "a", "inc", "1")], (2, "a"): [(-4, "a", "set", "5"), (-2, "b", "unset", None)],
        (3, "a"): None, (4, None): None, (5, "a"): [(-3, "a", "inc", "12")], (5, "b"): [(-2, "b", "set", "1")],
    }


def test_stream_and_replay(spark, tmp_path):
    made = random_log(5)
    for k in range(3):
        log(spark, *made[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.start(stream.read_events(spark, str(tmp_path / "in"), files_per_batch=1), str(tmp_path / "store"), str(tmp_path / "ckpt"), buckets=4)
    q.awaitTermination()
    store = stream.Store(spark, str(tmp_path / "store"))
    want = tables(fold.fold(log(spark, *made)))
    assert tables(store.read()) == want and store.buckets == 4 and store.acknowledged() == 59
    last = store.versions()[-1]
    stream.apply_batch(store, log(spark, *made[40:]), last - 1)  # a batch that comes again changes nothing
    assert tables(store.read()) == want and store.versions()[-1] == last


def test_stream_of_attributes_moved_in_a_later_batch(spark, tmp_path):
    link, cut = lambda n: dict(type="LINK", id=1, parent_id=1, name=n), dict(type="PARTIAL_UNLINK", id=1, rm_time=7)
    x = lambda op, v, n: dict(type="XATTR", id=1, ns=True, key="k", op=op, value=v, parent_id=1, name=n)
    made = [dict(e, seq=k) for k, e in enumerate([link("a"), x("set", "2", "a"), cut, link("b"), x("inc", "3", "b"), cut])]
    for part in (made[:5], made[5:]):
        log(spark, *part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.start(stream.read_events(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "ckpt"), buckets=4).awaitTermination()
    got = stream.Store(spark, str(tmp_path / "store")).read().xattrs
    assert [(r["name"], r["value"]) for r in got.collect()] == [(None, "5")] and plain_attributes(made) == {(1, None, "k"): "5"}


def test_stream_of_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    empty.write.parquet(str(tmp_path / "events.parquet"))
    assert registry.QUERIES["stream_xattrs"](spark, str(tmp_path)).collect() == []


def test_attributes_of_links_without_an_id_or_a_seq(spark):
    made = [dict(type=t, parent_id=1, name="a", **more) for t, more in [("LINK", {}), ("XATTR", dict(ns=True, key="k", op="set", value="1"))]]
    nameless = [dict(e, id=None, parent_id=None) for e in made]  # as of a row without a user
    late = [dict(made[0], id=2, seq=None), dict(made[1], id=2)]
    known = [dict(e, id=3) for e in made]
    assert [r["id"] for r in fold.fold_xattrs(log(spark, *made, *nameless, *late, *known)).collect()] == [3]


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    store = stream.Store(spark, str(tmp_path / "s"), buckets=32)
    ids = spark.range(1000).select(F.col("id").alias("seq"), F.lit("UPSERT").alias("type"), "id", F.lit("x").alias("symlink"))
    stream.apply_batch(store, ids, 0)
    ten = ids.where("id < 10").withColumns({"seq": F.col("id") + 5000, "symlink": F.lit("y")})
    for n in (1, 2, 3):
        stream.apply_batch(store, ten, n)
    made = [p.name for p in (tmp_path / "s" / "data" / "4" / "inodes").iterdir() if p.name.startswith("bucket=")]
    assert 1 <= len(made) <= 10
    got = Counter(r["symlink"] for r in store.read().inodes.collect())
    assert got == {"x": 990, "y": 10} and len(store.versions()) == 3
    with pytest.raises(ValueError, match="format"):
        text = (tmp_path / "s" / "done" / "4").read_text().replace('"format": 1', '"format": 9')
        (tmp_path / "s" / "done" / ".4.crc").unlink(missing_ok=True)
        (tmp_path / "s" / "done" / "4").write_text(text)
        stream.Store(spark, str(tmp_path / "s"))


def test_open_events_are_filled_or_refused(spark):
    ev = log(spark, dict(type="UPSERT", id=1, uid=7, fill=["statx.size", "statx.mtime"]), dict(type="UPSERT", id=2, size=3), dict(type="UPSERT", id=4, fill=["statx.size"]), dict(type="UPSERT", id=1, fill=["symlink"]))
    live = spark.createDataFrame([(1, 11, 12, 13, "/t")], "id long, size long, uid long, mtime_sec long, symlink string")
    got = {r["seq"]: (r["id"], r["statx"] and r["statx"]["size"], r["statx"] and r["statx"]["uid"], r["symlink"]) for r in enrich.fill(ev, live).collect()}
    assert got == {0: (1, 11, 7, None), 1: (2, 3, None, None), 3: (1, None, None, "/t")}
    with pytest.raises(Exception, match="no such entry"):
        enrich.fill(ev, live, skip=False).collect()
    with pytest.raises(Exception, match="not complete"):
        enrich.reject_open(ev).collect()
    assert enrich.reject_open(enrich.fill(ev, live)).count() == 3


def test_stream_fills_from_a_snapshot(spark, tmp_path):
    schema = "idx long, rec_type string, target long, parent long, name string, flags int, time_sec long, uid long, gid long, fid string"
    rows = [(1, "CREAT", 5, 1, "a", 0, 9, 3, 4, "0x5"), (2, "CLOSE", 5, None, None, 0, 9, None, None, None), (3, "CREAT", 6, 1, "b", 0, 9, 3, 4, "0x6"), (4, "UNLNK", 6, 1, "b", 1, 9, None, None, None), (5, "ATIME", 8, None, None, 0, 9, None, None, None)]
    ev = changelog.expand(spark.createDataFrame(rows, schema))
    entries_ = spark.createDataFrame([(1, 0, "", "/", DIR, 4096, None), (5, 1, "a", "/a", FILE, 77, {"hsm_state": "8", "other": "1"})], "id long, parent_id long, name string, path string, type int, size long, xattrs map<string,string>")
    got = {}
    for dedup in (True, False):
        store = stream.Store(spark, str(tmp_path / str(dedup)))
        stream.apply_batch(store, ev, 0, enrich.snapshot_of(entries_), dedup)
        got[dedup] = tables(store.read())
        m = store.read()
        assert {(r["id"], r["type"], r["size"], r["uid"]) for r in m.inodes.collect()} == {(1, DIR, None, None), (5, FILE, 77, 3)}
        assert {(r["id"], r["ns"], r["key"], r["value"]) for r in m.xattrs.collect()} == {(5, False, "fid", '"0x5"'), (5, False, "hsm_state", "8"), (5, True, "path", '"/a"'), (1, False, "nb_children", "1")}
    assert got[True] == got[False]
    changelog.dump(spark.createDataFrame(rows, schema), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).count() == 5


def test_events_to_files_and_back(spark, tmp_path):
    made = log(spark, *random_log(3))
    stream.write_events(made, str(tmp_path / "json"))
    back = spark.read.schema(events.SCHEMA).json(str(tmp_path / "json"))
    assert tables(fold.fold(back)) == tables(fold.fold(made))
    q = stream.write_events(stream.read_events(spark, str(tmp_path / "json"), kind="json"), str(tmp_path / "again"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert spark.read.schema(events.SCHEMA).json(str(tmp_path / "again")).count() == 60
    assert [r["seq"] for r in stream.first_events(made, 3, after=10).collect()] == [11, 12, 13]


def test_changelog(spark):
    schema = "idx long, rec_type string, target long, parent long, name string, source_parent long, source_name string, overwritten long, flags int, time_sec long"
    rows = [(1, "CREAT", 5, 1, "a", None, None, None, 0, 9), (2, "RENME", 5, 2, "b", 1, "a", None, 0, 9), (3, "RENME", 6, 2, "b", 1, "c", 5, 1, 9), (4, "UNLNK", 6, 2, "b", None, None, None, 3, 9), (5, "MARK", 0, 0, "", None, None, None, 0, 9), (6, "ATIME", 6, None, None, None, None, None, 0, 9)]
    got = changelog.expand(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    kinds = [(r["seq"] // 8, r["type"]) for r in got]
    assert [k for i, k in kinds if i == 1] == ["LINK", "XATTR", "UPSERT", "UPSERT", "XATTR"]
    assert [k for i, k in kinds if i == 2] == ["LINK", "UPSERT", "UPSERT", "XATTR", "UNLINK", "UPSERT", "XATTR"]
    assert [k for i, k in kinds if i == 3] == ["DELETE", "LINK", "UPSERT", "UPSERT", "UNLINK", "UPSERT", "XATTR"]
    assert [k for i, k in kinds if i == 4] == ["PARTIAL_UNLINK", "UPSERT", "XATTR"]
    assert not [k for i, k in kinds if i == 5]
    assert [(r["statx"], r["fill"]) for r in got if r["seq"] // 8 == 6 and r["type"] == "UPSERT"] == [(None, ["statx.atime"])]


def test_policy_units():
    assert policy.parse_time("2h") == (120, "min") and policy.parse_time("3 weeks") == (21, "day") and policy.parse_time("1mo") == (30, "day")
    assert policy.parse_quantity("3k") == 3000 and policy.parse_bytes("2KB") == 2048
    assert policy.parse_date("1970-01-02") == 86_400
    days = {policy.parse_date(t) for t in ("2024-07-30", "30/07/2024", "30-07-2024", "2024/07/30", "2024.07.30", "30.07.2024", "2024-07-30T00:00:00")}
    assert len(days) == 1 and None not in days and policy.parse_date("2024-07-30 10:00") is None
    size = lambda op: policy.in_units(op, "statx.size", 5, 1024)
    assert (size(">"), size(">="), size("<"), size("<=")) == (Cmp(">", "statx.size", 5120), Cmp(">", "statx.size", 4096), Cmp("<=", "statx.size", 4096), Cmp("<=", "statx.size", 5120))
    assert size("=") == And((Cmp(">", "statx.size", 4096), Cmp("<", "statx.size", 5121)))
    age = lambda op: policy.at_age(op, "statx.mtime", 1000, 5, 60)
    assert (age(">"), age(">="), age("<"), age("<=")) == (Cmp("<", "statx.mtime", 700), Cmp("<", "statx.mtime", 760), Cmp(">", "statx.mtime", 700), Cmp(">", "statx.mtime", 640))
    for bad in (lambda: policy.parse_time("5 parsecs"), lambda: policy.parse_time("3 mos"), lambda: policy.Pool == "x", lambda: policy.Name > "a", lambda: policy.Size > "1XB", lambda: policy.parse_quantity("1.5")):
        with pytest.raises(UsageError):
            bad()


def test_policy_run(spark):
    e = entries(spark, {f"f{k}": k * 1000 for k in range(10)}).withColumn("uid", F.lit(5).cast("long")).withColumn("gid", F.lit(1).cast("long"))
    ctx = Context(now=1_000_000, users={"u": 5})
    seen = []
    p = policy.Policy("p", policy.Type == "file", lambda r: seen.append(("own", r["id"])), rules=(policy.Rule("big", policy.Size >= "5KB", lambda r: seen.append(("big", r["id"])), max_count=2),), sort=(("size", False),), trigger=policy.mirror_trigger("User", ["u"], "FileCount", ">", 5))
    out = policy.run(p, e, ctx)
    assert out.ran and out.by_rule == {"big": 2, None: 6} or out.by_rule["big"] == 2
    assert [x for x in seen if x[0] == "big"] == [("big", 11), ("big", 10)]
    never = policy.Policy("p", policy.Type == "file", None, trigger=policy.scheduled("2100-01-01") & policy.periodic("1h"))
    assert not policy.run(never, e, ctx).ran and policy.run(never, e, ctx, manual=True).ran
    stop = policy.Policy("p", policy.Type == "file", lambda r: None, stop=policy.Always_)
    assert policy.run(stop, e, ctx).done == 1 and policy.run(stop, e, ctx).stopped
    assert policy.capacity(lambda: 91.0, ">", 90).test(e, ctx)
    fails = policy.Policy("p", policy.Name == "f1", lambda r: 1 / 0)
    assert policy.run(fails, e, ctx).errors == 1
    fc = policy.FileClass("small", policy.Size < "3KB")
    assert find.select(e, (fc & (policy.Type == "file")).build(ctx)).count() == 3


def test_trees_and_gc(spark):
    rows = [(1, 0, "", DIR), (2, 1, "d", DIR), (3, 2, "f", FILE), (4, 1, "g", FILE), (5, 9, "lost", FILE)]
    e = spark.createDataFrame(rows, "id long, parent_id long, name string, type int")
    assert {r["id"]: r["path"] for r in tree.derive_paths(e).collect()} == {1: "/", 2: "/d", 3: "/d/f", 4: "/g"}
    assert sorted(r["id"] for r in tree.branch(e, 2).collect()) == [2, 3]
    broken = e.withColumn("path", F.when(F.col("id") == 3, "/old/f").when(F.col("id") == 2, "/d").when(F.col("id") == 1, "/"))
    fixed = {r["id"]: (r["path"], r["repaired"]) for r in tree.repair_paths(broken).collect()}
    assert fixed[3] == ("/d/f", True) and fixed[2] == ("/d", False) and fixed[5] == (None, False)
    m = fixed and tree.repair_paths(broken).withColumn("nlink", F.when(F.col("id") == 3, 2).otherwise(1)).withColumn("sync_time", F.lit(5))
    live = spark.createDataFrame([(2, "/d"), (3, "/elsewhere")], "id long, path string")
    assert sorted(r["id"] for r in maintenance.dead_links(m, live).collect()) == [1, 3, 4, 5]
    assert maintenance.dead_links(m, live, before=5).count() == 0


def test_facts(spark):
    old = [("backend_source", '["a"]'), ("mountpoint", '"/x"'), ("fsevents_source", '{"m":"1","n":"2"}'), ("command_backend", '"c"')]
    new = [("backend_source", '["b","a"]'), ("mountpoint", '"/y"'), ("fsevents_source", '{"n":"3"}')]
    got = maintenance.upsert_info(spark.createDataFrame(old, maintenance.FACTS), spark.createDataFrame(new, maintenance.FACTS))
    assert {r["name"]: r["value"] for r in got.collect()} == {"backend_source": '["a","b"]', "mountpoint": '"/y"', "fsevents_source": '{"m":"1","n":"3"}', "command_backend": '"c"'}
    runs = spark.createDataFrame([(1, "sync", 5)], "log_id long, command string, started long")
    assert maintenance.append_log(runs, "gc", 9, {"removed": "3"}).count() == 2
    for command, fields in (("dance", {}), ("gc", {"steps": "1"})):
        with pytest.raises(UsageError):
            maintenance.append_log(runs, command, 9, fields)


def test_checked_actions(spark):
    e = entries(spark, {"a": 5, "b": 7})
    fresh = e.withColumn("size", F.when(F.col("name") == "a", 1).otherwise(F.col("size")))
    done = []
    assert list(find.run(e, "-size +4c -type f -checked-exec rm {} ;".split(), execute=done.append, fresh=fresh)) == [] and done == [["rm", "/b"]]
    with pytest.raises(UsageError):
        list(find.run(e, "-checked-exec rm {} ;".split(), execute=done.append))
    assert find.entry_at(e, "/b").first()["size"] == 7 and find.entry_at(e, "/").first()["id"] == 1 and find.entry_at(e, "/b/c").count() == 0


def test_file_lists_refuse_other_fields(spark, tmp_path):
    objects.write_list(entries(spark, {"a": 5, "b": 7}), str(tmp_path / "l"))
    assert objects.read_list(spark, str(tmp_path / "l"), parse("-size +5c".split()).filter).where("type = 32768").count() == 1
    with pytest.raises(UsageError):
        objects.read_list(spark, str(tmp_path / "l"), parse("-uid 5".split()).filter)


def test_stop_thresholds_count_once(spark):
    e = entries(spark, {f"f{k}": 10 for k in range(8)}).withColumns({"uid": F.lit(5).cast("long"), "gid": F.lit(1).cast("long")})
    ctx, seen = Context(now=0, users={"u": 5}, groups={"g": 1}), []
    p = policy.Policy("p", policy.Type == "file", "delete", stop=policy.mirror_trigger("User", ["u"], "FileCount", "<=", 5) & policy.mirror_trigger("Group", ["g"], "DiskUsage", "<", "145"))
    out = policy.run(p, e, ctx, lambda action, row: seen.append(row["id"]))
    assert out.stopped and out.done == 4 == len(seen)  # 100 + 8 * 10 bytes: after four removals 140 are left
    kept = policy.run(policy.Policy("p", policy.Type == "file", "log", stop=p.stop), e, ctx, lambda action, row: None)
    assert kept.done == 8 and not kept.stopped


def test_restore(spark):
    m = entries(spark, {"a": 3}).withColumn("uid", F.lit(1).cast("long")).withColumn("rm_time", F.when(F.col("name") == "a", 9))
    assert [(r["type"], r["id"]) for r in maintenance.restore_events(m, "/a", 77).collect()] == [("UPSERT", 77), ("LINK", 77), ("DELETE", 2)]


def test_scan_and_sync(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("hello")
    (tmp_path / "l").symlink_to("d/x.txt")
    got = {r["path"]: r for r in scanner.scan(spark, str(tmp_path)).collect()}
    assert set(got) == {"/", "/d", "/d/x.txt", "/l"}
    assert got["/d/x.txt"]["size"] == 5 and got["/l"]["symlink"] == "d/x.txt" and got["/d/x.txt"]["parent_id"] == got["/d"]["id"]
    mirror = fold.fold(sync.events(scanner.scan(spark, str(tmp_path))))
    assert mirror.links.count() == 4 and mirror.inodes.count() == 4
    assert {r["symlink"] for r in mirror.inodes.collect()} == {None, "d/x.txt"} and mirror.xattrs.where("ns AND key = 'path'").count() == 4
    with pytest.raises(Exception, match="no id"):
        sync.events(scanner.scan(spark, str(tmp_path)).withColumn("name", F.lit(None).cast("string")), skip=False).collect()
    with pytest.raises(UsageError):
        sync.projection(["-id"], frozenset({"id"}))


def test_projection_of_time_stamps(spark):
    view = spark.createDataFrame([(1, 2, 3, 4, 5)], "id long, mtime_sec long, mtime_nsec int, size long, ctime_sec long")
    columns = lambda *changes: sync.project(view, sync.projection(list(changes))).columns
    assert columns("id", "statx.mtime") == ["id", "mtime_sec"]  # as in predicates
    assert columns("statx.mtime.sec", "+statx.mtime.nsec") == ["mtime_nsec", "mtime_sec"]
    assert columns() == columns("id", "statx") == sorted(view.columns)
    assert columns("-statx.mtime") == ["ctime_sec", "id", "size"] and columns("-statx.mtime.nsec") == ["ctime_sec", "id", "mtime_sec", "size"]
    sent = sync.events(view.withColumns({"parent_id": F.lit(0), "name": F.lit("")}), sync.projection(["statx.mtime"])).first()["statx"]
    assert (sent["mtime_sec"], sent["mtime_nsec"]) == (2, 3)  # a mirror gets whole stamps


def test_trees_of_any_depth(spark):
    deep = 68
    rows = [(1, 0, "", DIR)] + [(k, k - 1, "d", DIR) for k in range(2, deep + 2)] + [(900, deep + 1, "f", FILE), (500, 501, "a", DIR), (501, 500, "b", DIR), (502, 501, "g", FILE)]
    e = spark.createDataFrame(rows, "id long, parent_id long, name string, type int").coalesce(1).withColumn("path", F.lit("?"))
    assert sorted(r["id"] for r in tree.branch(e, 1).collect()) == [*range(1, deep + 2), 900]
    assert sorted(r["id"] for r in tree.branch(e, 500).collect()) == [500, 501, 502]
    fixed = {r["id"]: (r["path"], r["repaired"]) for r in tree.repair_paths(e).collect()}
    assert fixed[900] == ("/d" * deep + "/f", True) and fixed[502] == ("?", False) and len(fixed) == len(rows)
