"""Store addresses: `SCHEME:BACKEND:NAME[#PATH or #[ID]]`."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.patterns import UsageError, parse_fid


@dataclass(frozen=True)
class Uri:
    backend: str
    name: str
    path: str | None = None
    id: bytes | None = None


def percent_decode(text: str) -> bytes:
    out, i = bytearray(), 0
    while i < len(text):
        if text[i] == "%":
            if not re.fullmatch("[0-9a-fA-F]{2}", text[i + 1 : i + 3]):
                raise UsageError(f"invalid percent encoding in {text!r}")
            out.append(int(text[i + 1 : i + 3], 16))
            i += 3
        else:
            out += text[i].encode()
            i += 1
    return bytes(out)


#: Scheme of addresses unless another one is given.
SCHEME = "entrywise"


def parse_uri(text: str, scheme: str = SCHEME) -> Uri:
    m = re.fullmatch(re.escape(scheme) + r":([^:#]+):([^#]*)(?:#(.*))?", text, re.S)
    if not m:
        raise UsageError(f"invalid address: {text!r}")
    backend, name, fragment = m[1], percent_decode(m[2]).decode(), m[3]
    if not name:
        raise UsageError(f"no store name in {text!r}")
    if fragment is None:
        return Uri(backend, name)
    if fragment.startswith("[") and fragment.endswith("]"):
        inner = fragment[1:-1]
        return Uri(backend, name, id=parse_fid(inner) if ":" in inner else percent_decode(inner))
    return Uri(backend, name, path=percent_decode(fragment).decode())
