"""Encoding and delimiter of delimited text, from bytes."""

from __future__ import annotations

import codecs
import re

#: Byte order marks, longest first, with the encodings they mean (fixed values).
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
DELIMITERS = b",;\t|"
FALLBACK, SAMPLE = "cp949", 1 << 20


def is_utf8(data: bytes, cut: bool = True) -> bool:
    """Strictly valid UTF-8; with ``cut``, a character cut off at the end is all right."""
    try:
        codecs.getincrementaldecoder("utf-8")("strict").decode(data, final=not cut)
    except UnicodeDecodeError:
        return False
    return True


def encoding(parts: list[bytes]) -> tuple[str, int]:
    """(encoding, bytes of its mark) from samples of a file's head, middle and tail; the last two may begin within a character."""
    head = parts[0] if parts else b""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name, len(mark)
    for k, part in enumerate(parts):
        if not is_utf8(re.sub(rb"\A[\x80-\xBF]{1,3}", b"", part) if k else part):
            return FALLBACK, 0
    return "utf-8", 0


def delimiter(sample: bytes) -> str:
    """The most frequent of ``, ; tab |`` outside quotes on the first line, the earlier of equals; comma if there is none."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for b in sample:
        if b == 0x22:
            quoted = not quoted
        elif not quoted:
            if b in b"\r\n":
                break
            if b in counts:
                counts[b] += 1
    best = max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))
    return chr(best) if counts[best] else ","
