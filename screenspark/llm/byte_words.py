"""Words cut from UTF-8 bytes with one translation table, in blocks of bounded size.

Letters A-Z become a-z; digits, a-z and every byte of a character beyond ASCII stay;
any other byte becomes a blank. ``bytes.split`` then yields the words. A character
beyond ASCII is never cut, because all of its bytes stay.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc


def _translated(b: int) -> int:
    if ord("A") <= b <= ord("Z"):
        return b + 32
    return b if ord("0") <= b <= ord("9") or ord("a") <= b <= ord("z") or b >= 0x80 else ord(" ")


TABLE = bytes(map(_translated, range(256)))
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def word_slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists that together are ``words(text)``; each takes some ``size`` bytes.

    A single word longer than that is not cut.
    """
    blank = text.translate(TABLE)
    begin = 0
    while begin < len(blank):
        end = blank.find(b" ", begin + size)
        end = len(blank) if end < 0 else end
        yield blank[begin:end].split()
        begin = end


def row_blocks(tables: Iterable[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the incoming batches with some ``size`` bytes of the binary column ``text``; one long text is one block."""
    for table in tables:
        begin, held = 0, 0
        for i, n in enumerate(pc.binary_length(table[text]).to_pylist()):
            if held and held + (n or 0) > size:
                yield table.slice(begin, i - begin)
                begin, held = i, 0
            held += (n or 0) + 64
        if begin < table.num_rows:
            yield table.slice(begin)
