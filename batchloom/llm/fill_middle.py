"""Fill-in-middle transformation: a text is cut at two token ends and its parts are dealt anew, by big-integer bit parallelism.

One bit stands for one byte of the text's UTF-8. ``bytes.translate`` turns the text into such bits by character class (all
blanks are ASCII, so no byte of a longer character is taken for one), a shifted boolean operation marks the last byte of each
token, ``bit_count`` gives the number of tokens, and the two ranked bits at which the text is cut are found by halving: the
lower half's count tells on which side a rank lies. Counts of code points come from the mask of continuation bytes.

A token is a word with the blanks before it; blanks after the last word are one more.

Defined cases: a null or empty text is left plain, with no tokens and null lengths; a text that contains one of the marks is
left plain, so that every output can be read back; very long texts are whole, a few integers of one bit a byte each; repeated
rows are transformed each by themselves, with equal results; a null id counts as the empty string in the draw; other columns
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, raw_text

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
SEED = "42"
#: Percent of texts that are transformed, and of these the percent whose suffix comes first.
RATE = 50
SPM_RATE = 80

_WORDS = bytes(48 if b in BLANKS else 49 for b in range(256))
_CONTINUED = bytes(49 if 0x80 <= b < 0xC0 else 48 for b in range(256))


def mask(raw: bytes, table: bytes) -> int:
    """The bits of the bytes that ``table`` turns into "1"; the first byte is the lowest bit."""
    return int(raw.translate(table)[::-1] or b"0", 2)


def token_ends(raw: bytes) -> int:
    """A bit at the last byte of every token."""
    words = mask(raw, _WORDS)
    ends = words & ~(words >> 1)
    return ends | (1 << (len(raw) - 1)) if raw else 0


def select(bits: int, rank: int, width: int) -> int:
    """The place of the set bit of that rank, from 1, among ``width`` bits."""
    at = 0
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank <= below:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - below, at + half, width - half
    return at


def draws(doc_id: object, seed: str = SEED) -> list[int]:
    """The first four 32-bit numbers of the digest of seed and id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(h[k : k + 4], "big") for k in (0, 4, 8, 12)]


def cut(raw: bytes, h1: int, h2: int) -> tuple[int, int, int]:
    """(tokens, end of the prefix, end of the middle) in bytes."""
    ends = token_ends(raw)
    n = ends.bit_count()
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    place = lambda k: select(ends, k, len(raw)) + 1 if k else 0
    a = place(first)
    return n, a, a if last == first else place(last)


def compose(raw: bytes, a: int, b: int, form: str) -> bytes:
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if form == "psm":
        return PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle if form == "spm" else raw


def restore(out: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return out
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = out.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform_text(raw: bytes, doc_id: object, seed: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output)."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n, a, b = cut(raw, h1, h2)
    if not raw or PREFIX in raw or SUFFIX in raw or MIDDLE in raw or h3 % 100 >= rate:
        return n, "plain", None, None, raw
    form = "spm" if h4 % 100 < spm_rate else "psm"
    continued = mask(raw[:b], _CONTINUED)
    before = (continued & ((1 << a) - 1)).bit_count()
    return n, form, a - before, b - a - (continued.bit_count() - before), compose(raw, a, b, form)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, restored): ``output`` is the transformed text, ``restored`` the text read back from it."""

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {"id": b["id"], "n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": [], "restored": []}
            for doc_id, raw in zip(b["id"], b["raw"]):
                n, form, p, m, text = transform_text(raw, doc_id, seed, rate, spm_rate)
                for name, v in zip(("n", "form", "prefix_chars", "middle_chars", "output", "restored"), (n, form, p, m, text, restore(text, form))):
                    out[name].append(v)
            yield out

    kind = dict(docs.dtypes)[id_col]
    done = map_arrow(docs.select(F.col(id_col).alias("id"), raw_text(text_col).alias("raw")), rows, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")
    return done.withColumnRenamed("id", id_col)
