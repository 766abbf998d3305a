"""Fill-in-middle training texts, cut at token borders found by a parallel automaton scan.

Tokens are runs of A-Z and a-z, or one other character.  Whether a letter begins a token depends
on the character before it, so the scan is an automaton of two states, outside and inside a
run.  A chunk of text is a function on them: for each start state the state at its end and
the tokens that begin in it.  Functions compose associatively, so the chunks of a long text
are scanned wherever they lie, and composing their functions in order gives each chunk's
entry state and the tokens before it.  A cut after so many tokens is then looked up in the one
chunk that holds it.  A text of one chunk is its own function and needs no exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorweave.llm.common import small_batches
from factorweave.llm.words import pieces, text_buffer

OUT, IN = 0, 1
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def scan(data: np.ndarray, firsts: np.ndarray, entry: int = OUT) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens and where characters begin among UTF-8 bytes; texts begin at `firsts`, in state `entry`."""
    char, letter = (data & 0xC0) != 0x80, _LETTER[data]
    inside = np.concatenate([[False], letter[:-1]]) if len(data) else np.zeros(0, bool)
    inside[firsts[firsts < len(data)]] = entry == IN
    return char & ~(letter & inside), char


def function_of(data: np.ndarray) -> tuple[list[int], list[int], int]:
    """(exit states, token counts, characters) of a chunk; the first two for each start state."""
    if not len(data):
        return [OUT, IN], [0, 0], 0
    starts, char = scan(data, np.zeros(1, int))
    count = int(np.count_nonzero(starts))
    last = IN if _LETTER[data[-1]] else OUT
    return [last, last], [count, count - int(_LETTER[data[0]])], int(np.count_nonzero(char))


def compose(exits: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry state, tokens before) of each chunk: the functions of all chunks before it, composed by doubling."""
    exits, counts, step = exits.copy(), counts.copy(), 1
    while step < len(exits):
        first, then = exits[:-step], exits[step:]
        counts[step:] = counts[:-step] + np.take_along_axis(counts[step:], first, 1)
        exits[step:] = np.take_along_axis(then, first, 1)
        step *= 2
    return np.concatenate([[OUT], exits[:-1, OUT]]), np.concatenate([[0], counts[:-1, OUT]])


def _numbers(digest: str) -> list[int]:
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _plan(n: int, digest: str, marked: bool, rate: int, spm: int) -> tuple[int, int, str]:
    """(tokens before the first cut, before the second, form)."""
    h = _numbers(digest)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return a, b, "plain" if not n or marked or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm else "psm"


def _render(text: bytes, a: int, b: int, form: str) -> bytes:
    p, s, m = (x.encode() for x in MARKS)
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def _rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """rows: (n, form, prefix_chars, middle_chars, output)."""
    n, form, prefix, middle, out = zip(*rows, strict=True)
    plain = np.array([f == "plain" for f in form])
    chars = [pa.array(np.array(c, np.int64), mask=plain) for c in (prefix, middle)]
    return pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(form), *chars, pa.array(out, pa.binary()).cast(pa.string())], schema=_RESULT_ARROW)


def _whole(rate: int, spm: int):
    """Texts of one chunk, many at a time."""

    def rows(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = text_buffer(part.column(1))
                starts, char = scan(data, offsets[:-1])
                places = np.append(np.flatnonzero(starts), len(data))
                first = np.searchsorted(places[:-1], offsets)
                chars = np.concatenate([[0], np.cumsum(char)])
                buffer, done = data.tobytes(), []
                for i, (digest, marked) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    begin, end, n = int(offsets[i]), int(offsets[i + 1]), int(first[i + 1] - first[i])
                    a, b, form = _plan(n, digest, marked, rate, spm)
                    at = [min(int(places[first[i] + k]), end) - begin for k in (a, b)]
                    prefix, upto = (int(chars[begin + k] - chars[begin]) for k in at)
                    done.append((n, form, prefix, upto - prefix, _render(buffer[begin:end], *at, form)))
                yield _rows(part.column(0), done)

    return rows


def _border(data, k: int, chunk: int) -> int:
    """Where chunk k of a text begins: at the first character from byte k * chunk on."""
    at = min(k * chunk, len(data))
    while at < len(data) and (data[at] & 0xC0) == 0x80:
        at += 1
    return at


def _cut(chunk: int):
    """(key, digest, no, data) for each chunk."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                text = memoryview(batch.column(1)[i].as_buffer())
                own = [batch.column(k)[i].as_py() for k in (0, 2)]
                k, at = 0, 0
                while at < len(text):
                    end = _border(text, k + 1, chunk)
                    yield pa.record_batch([pa.array([own[0]]), pa.array([own[1]]), pa.array([k], pa.int32()), pa.array([bytes(text[at:end])], pa.binary())], names=["key", "digest", "no", "data"])
                    k, at = k + 1, end

    return rows


def _functions(batches):
    for batch in batches:
        got = [function_of(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)) for i in range(batch.num_rows)]
        exits, counts, chars = zip(*got, strict=True) if got else ((), (), ())
        yield pa.record_batch([*batch.columns[:3], pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64())), pa.array(chars, pa.int64())], names=["key", "digest", "no", "exits", "counts", "chars"])


_CUT = "key string, n long, a struct<no:int,rank:long,entry:int,chars:long>, b struct<no:int,rank:long,entry:int,chars:long>"


def _select(key, pdf):
    """The chunk that holds each cut of one text, from its chunks' functions: at most 2 GB / chunk rows."""
    import pandas as pd

    pdf = pdf.sort_values("no")
    counts = np.stack(pdf["counts"].to_list())
    entry, before = compose(np.stack(pdf["exits"].to_list()).astype(np.int64), counts)
    n = int(before[-1] + counts[-1, entry[-1]])
    chars = np.concatenate([[0], np.cumsum(pdf["chars"].to_numpy())])
    a, b, _ = _plan(n, pdf["digest"].iloc[0], False, 100, 0)

    def find(c: int) -> dict:
        k = int(np.searchsorted(before, c, "right")) - 1
        return {"no": k, "rank": c - int(before[k]), "entry": int(entry[k]), "chars": int(chars[k])}

    return pd.DataFrame({"key": [key[0]], "n": [n], "a": [find(a)], "b": [find(b)]})


def _place(data: np.ndarray, at: dict, chunk: int) -> tuple[int, int]:
    """(bytes, characters) before a cut of a long text."""
    begin, end = (_border(data, at["no"] + k, chunk) for k in (0, 1))
    starts, char = scan(data[begin:end], np.zeros(1, int), at["entry"])
    places = np.flatnonzero(starts)
    off = int(places[at["rank"]]) if at["rank"] < len(places) else end - begin
    return begin + off, at["chars"] + int(np.count_nonzero(char[:off]))


def _long(chunk: int, rate: int, spm: int):
    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, text, digest, marked, n, a, b = (batch.column(k) for k in range(7))
                data = np.frombuffer(text[i].as_buffer(), np.uint8)
                (at, prefix), (to, upto) = (_place(data, x[i].as_py(), chunk) for x in (a, b))
                form = _plan(n[i].as_py(), digest[i].as_py(), marked[i].as_py(), rate, spm)[2]
                yield _rows(ids.slice(i, 1), [(n[i].as_py(), form, prefix, upto - prefix, _render(data.tobytes(), at, to, form))])

    return rows


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, chunk: int = 1 << 16) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: its text as a fill-in-middle example.

    Both cuts and the form come from the sha256 of `seed:doc_id` (a null id: nothing after
    the colon), so they don't depend on how rows are dealt.  rate % of the texts are
    transformed, spm % of these with the suffix first; the form is plain, and output the text,
    for the rest and for texts that are empty or hold a mark already.  Null text counts as
    empty.  Repeated rows give a row each; other columns are ignored.

    Texts of more than `chunk` bytes are dealt out by chunks, and only these are shuffled; the
    result is the same for every chunk size.
    """
    small_batches(docs.sparkSession)
    id_ = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    marked: Column = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(text, F.lit(m))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), digest.alias("digest"), marked.alias("marked"))
    short = rows.where(F.octet_length("text") <= chunk).mapInArrow(_whole(rate, spm), _RESULT)
    long = rows.where(F.octet_length("text") > chunk).withColumn("key", F.sha2(F.concat("digest", "text"), 256))
    dealt = long.select("key", "text", "digest").mapInArrow(_cut(chunk), "key string, digest string, no int, data binary").repartition("key", "no")
    functions = dealt.mapInArrow(_functions, "key string, digest string, no int, exits array<int>, counts array<long>, chars long").dropDuplicates(["key", "no"])  # of repeated rows
    cuts = functions.groupBy("key").applyInPandas(_select, _CUT)
    found = long.join(cuts, "key").select("doc_id", "text", "digest", "marked", "n", "a", "b")
    return short.unionByName(found.mapInArrow(_long(chunk, rate, spm), _RESULT))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: its parts between the marks, in order."""
    cut = F.split(output, "|".join(MARKS), -1)
    part = lambda i: F.get(cut, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = restored(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}
ORACLE_SQL = {
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(w) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
sha256(text) AS restored_sha256 FROM p"""
}
