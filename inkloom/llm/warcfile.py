"""Reading the records of a WARC file's bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator


def members(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, plain bytes) of each gzip member; a file that is not gzipped is one."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield 0, bytes(data)
        return
    at = 0
    while at < len(data) and bytes(data[at : at + 2]) == b"\x1f\x8b":
        inflate = zlib.decompressobj(31)
        plain = inflate.decompress(data[at:]) + inflate.flush()
        yield at, plain
        if not inflate.eof:
            return
        at = len(data) - len(inflate.unused_data)


def records(data: bytes | memoryview) -> Iterator[tuple[int, str, str, bytes]]:
    """(offset, record id, URL, payload) of each record. A record in a gzip member of its own has the member's offset in the file; further ones of a member have it too.

    A record whose length is no number is passed over up to the next one; one that ends early keeps what there is.
    """
    for begin, plain in members(memoryview(data)):
        zipped, at = begin > 0 or bytes(memoryview(data)[:2]) == b"\x1f\x8b", 0
        while (at := plain.find(b"WARC/1.", at)) >= 0:
            body = plain.find(b"\r\n\r\n", at)
            if body < 0:
                break
            head = dict(x.split(b":", 1) for x in plain[at:body].split(b"\r\n")[1:] if b":" in x)
            head = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, v in head.items()}
            size = head.get(b"content-length", "0")
            if not size.isdigit():
                at = body
                continue
            yield begin if zipped else at, head.get(b"warc-record-id", ""), head.get(b"warc-target-uri", ""), plain[body + 4 : body + 4 + int(size)]
            at = body + 4 + int(size)
