"""Fill-in-middle: cut texts at line ends into prefix, middle and suffix, and put the middle last.

Where lines end is a bit for each byte of a batch of texts, packed into 64-bit
words with a directory of how many bits are set before each block of 512. The
lines of a text are the bits between its first and last byte, and a cut after
the k-th line is the place of one more bit: rank and select, which look at one
block however long the text is. A second vector marks the bytes that begin a
character, so code points are counted the same way. Nothing is shuffled, and a
task holds one slice of a batch.

A null text is an empty one, and an empty one is left plain, as is one that
holds a marker. A null id is an empty string where cuts are drawn. Equal rows
give equal results; further columns stay as they are, unless they have the name
of a result, which then replaces them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows whose bit vectors are built at a time.
SLICE_ROWS = 500
WORDS_PER_BLOCK = 8
BLOCK_BITS = 64 * WORDS_PER_BLOCK

RESULTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


class BitVector:
    """Bits in 64-bit words, and how many are set before each block of words."""

    def __init__(self, bits: np.ndarray) -> None:
        # A block of zeros at the end, so that a place after the last bit has one too.
        n_blocks = len(bits) // BLOCK_BITS + 1
        packed = np.zeros(n_blocks * BLOCK_BITS // 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        packed[: len(some)] = some
        self.blocks = packed.view("<u8").reshape(n_blocks, WORDS_PER_BLOCK)
        in_block = np.bitwise_count(self.blocks).sum(axis=1, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(in_block)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set before each place."""
        block, inside = np.divmod(places, BLOCK_BITS)
        word, bit = np.divmod(inside, 64)
        words = self.blocks[block]
        whole = np.arange(WORDS_PER_BLOCK) < word[:, None]
        partial = words[np.arange(len(places)), word] & ((np.uint64(1) << bit.astype(np.uint64)) - np.uint64(1))
        return self.before[block] + (np.bitwise_count(words) * whole).sum(axis=1, dtype=np.int64) + np.bitwise_count(partial)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the bit that has k set ones before it."""
        block = np.searchsorted(self.before, k, side="right") - 1
        left = k - self.before[block]
        words = self.blocks[block]
        up_to = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        word = (up_to <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left -= np.where(word > 0, up_to[row, word - 1], 0)
        bits = (words[row, word][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        bit = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
        return block * BLOCK_BITS + word * 64 + bit


def draws(seed: int, doc_id: object) -> list[int]:
    """The first four 8-digit groups of the SHA-256 of seed:id, as numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins and the last ends."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


def cut_batch(ids: list, texts: pa.Array, seed: int, plain_percent: int, spm_percent: int) -> list[list]:
    """The columns of RESULTS for one slice."""
    data, at = text_bytes(texts)
    starts, ends = at[:-1], at[1:]
    line_ends = data == ord("\n")
    line_ends[ends[ends > starts] - 1] = True
    lines, chars = BitVector(line_ends), BitVector((data & 0xC0) != 0x80)
    first = lines.rank(starts)
    n = lines.rank(ends) - first
    h = np.array([draws(seed, i) for i in ids], np.int64).reshape(-1, 4)
    ranks = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    cuts = []
    for r in ranks.T:
        cut, some = starts.copy(), r > 0
        cut[some] = lines.select(first[some] + r[some] - 1) + 1
        cuts.append(cut)
    prefix_chars = chars.rank(cuts[0]) - chars.rank(starts)
    middle_chars = chars.rank(cuts[1]) - chars.rank(cuts[0])
    whole = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out: list[list] = [[], [], [], [], []]
    for i, (start, a, b, end) in enumerate(zip(starts.tolist(), cuts[0].tolist(), cuts[1].tolist(), ends.tolist(), strict=True)):
        text = whole[start:end]
        if not text or p in text or s in text or m in text or h[i, 2] % 100 >= 100 - plain_percent:
            row = (int(n[i]), "plain", None, None, text)
        else:
            before, after = p + whole[start:a], s + whole[b:end]
            spm = h[i, 3] % 100 < spm_percent
            row = (int(n[i]), "spm" if spm else "psm", int(prefix_chars[i]), int(middle_chars[i]), (after + before if spm else before + after) + m + whole[a:b])
        for column, x in zip(out, row, strict=True):
            column.append(x)
    return out


def fill_in_middle(docs: DataFrame, seed: int = 7, plain_percent: int = 0, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n (lines), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output, the rearranged text.

    psm is prefix, suffix, middle; spm is suffix, prefix, middle. The order of
    parts, not their text, differs; restored() gives the text back.
    """
    rest = [f for f in docs.schema.fields if f.name not in RESULTS.names or f.name in (id_col, text_col)]
    schema = T.StructType([*rest, *(f for f in RESULTS.fields if f.name not in (id_col, text_col))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                b = batch.slice(at, SLICE_ROWS)
                found = cut_batch(b.column(id_col).to_pylist(), b.column(text_col), seed, plain_percent, spm_percent)
                made = {name: pa.array(c, pa.binary()).cast(pa.string()) if name == "output" else pa.array(c, arrow.field(name).type) for name, c in zip(RESULTS.names, found, strict=True) if name in arrow.names}
                yield pa.RecordBatch.from_arrays([b.column(f.name) if f in rest else made[f.name] for f in schema.fields], schema=arrow)

    return docs.select(*(f.name for f in rest)).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() made output from. The markers are in a rearranged text once each."""
    size = len(PREFIX)

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        b, c = F.instr(output, second), F.instr(output, MIDDLE)
        return F.substring(output, F.lit(size + 1), b - (size + 1)), F.substring(output, b + size, c - b - size), F.substring(output, c + size, F.length(output))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late_suffix, late_prefix, late_middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)


def _draw_sql(k: int) -> str:
    return f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"


MIDDLE_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, h, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls FROM d),
c AS (SELECT *, len(ls) AS n, {_draw_sql(1)} % (len(ls) + 1) AS a, {_draw_sql(2)} % (len(ls) + 1) AS b FROM u),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN {_draw_sql(4)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(list_slice(ls, 1, least(a, b)), '') AS p, array_to_string(list_slice(ls, least(a, b) + 1, greatest(a, b)), '') AS m, array_to_string(list_slice(ls, greatest(a, b) + 1, n), '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
