"""Shell globs, sizes, times and file modes as the predicate language writes them."""

from __future__ import annotations

import re

#: Bytes of each size suffix.
SIZE_UNITS = {"b": 512, "c": 1, "w": 2, "k": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40, "P": 1 << 50, "E": 1 << 60}
#: File type bits by letter.
TYPES = {"b": 0o060000, "c": 0o020000, "d": 0o040000, "f": 0o100000, "l": 0o120000, "p": 0o010000, "s": 0o140000}
TYPE_NAMES = {TYPES["f"]: "file", TYPES["d"]: "directory", TYPES["l"]: "link", TYPES["b"]: "block", TYPES["c"]: "char", TYPES["p"]: "fifo", TYPES["s"]: "socket"}


class UsageError(ValueError):
    """A malformed command line."""


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a shell glob; a trailing newline is not ignored."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                out.append(r"\[")
            else:
                body = pattern[i:end]
                out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body).replace("\\", r"\\") + "]")
                i = end + 1
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        else:
            out.append(re.escape(c) if c in r".^$+{}()|\/#&~-" and c not in "/#&~-" else c)
    return "^" + "".join(out) + r"(?!\n)$"


def sign(text: str) -> tuple[str, str]:
    """The leading + or - of an argument, or '', and the rest."""
    return (text[0], text[1:]) if text[:1] in ("+", "-") else ("", text)


def whole(text: str) -> int:
    if not re.fullmatch(r"\d+", text):
        raise UsageError(f"expected a number: {text!r}")
    n = int(text)
    if n >= 1 << 64:
        raise UsageError(f"number out of range: {text}")
    return n


def size_unit(text: str) -> tuple[int, int]:
    """(count, bytes of the unit) of `N[EPTGMkbwc]`; blocks of 512 bytes by default."""
    m = re.fullmatch(r"(\d+)([EPTGMkbwc]?)", text)
    if not m:
        raise UsageError(f"invalid size: {text!r}")
    return int(m[1]), SIZE_UNITS[m[2] or "b"]


def parse_mode(text: str, umask: int = 0) -> int:
    """Permission bits of an octal or symbolic mode."""
    if re.fullmatch(r"[0-7]+", text):
        value = int(text, 8)
        if value > 0o7777:
            raise UsageError(f"invalid mode: {text!r}")
        return value
    shift = {"u": 6, "g": 3, "o": 0}
    mode = 0
    for clause in text.split(","):
        m = re.fullmatch(r"([ugoa]*)((?:[-+=](?:[rwxXst]*|[ugo]))+)", clause)
        if not m:
            raise UsageError(f"invalid mode: {text!r}")
        who = set(m[1].replace("a", "ugo")) or set("ugo")
        masked = umask if not m[1] else 0
        for op, perms in re.findall(r"([-+=])([ugo](?![rwxXst])|[rwxXst]*)", m[2]):
            bits = 0
            for w in who:
                if perms in ("u", "g", "o") and perms:
                    bits |= ((mode >> shift[perms]) & 7) << shift[w]
                    continue
                for p in perms:
                    if p in "rwx":
                        bits |= {"r": 4, "w": 2, "x": 1}[p] << shift[w]
                    elif p == "X" and mode & 0o111:
                        bits |= 1 << shift[w]
                    elif p == "s":
                        bits |= {"u": 0o4000, "g": 0o2000, "o": 0}[w]
            if "t" in perms and perms not in ("u", "g", "o") and ("o" in who or not m[1]):
                bits |= 0o1000
            bits &= ~masked
            if op == "+":
                mode |= bits
            elif op == "-":
                mode &= ~bits
            else:
                keep = 0
                for w in "ugo":
                    if w not in who:
                        keep |= 7 << shift[w]
                        keep |= {"u": 0o4000, "g": 0o2000, "o": 0o1000}[w]
                mode = (mode & keep) | bits
    return mode


def parse_fid(text: str) -> bytes:
    """16 bytes of `[0xSEQ:0xOID:0xVER]`, little-endian."""
    m = re.fullmatch(r"\[?(0[xX][0-9a-fA-F]+|\d+):(0[xX][0-9a-fA-F]+|\d+):(0[xX][0-9a-fA-F]+|\d+)\]?", text)
    if not m:
        raise UsageError(f"invalid fid: {text!r}")
    seq, oid, ver = (int(x, 0) for x in m.groups())
    if seq >= 1 << 64 or oid >= 1 << 32 or ver >= 1 << 32:
        raise UsageError(f"fid out of range: {text!r}")
    return seq.to_bytes(8, "little") + oid.to_bytes(4, "little") + ver.to_bytes(4, "little")
