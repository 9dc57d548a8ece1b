"""Fill-in-the-middle examples, made by DuckDB inside Arrow batches.

A text is cut into lines. Two places among them, drawn by a hash of the document's id,
part it into prefix, middle and suffix, which are put out in an order that asks for the
middle last: ``<P>``prefix``<S>``suffix``<M>``middle (psm), or ``<S>``suffix``<P>``prefix``<M>``middle
(spm). Of each batch DuckDB makes a table and one SQL statement: ``regexp_extract_all`` cuts the
lines, ``list_slice`` and ``array_to_string`` make the parts, ``sha256`` draws. Arrow comes out;
no Python runs per row. One scan, no shuffle; a task holds one slice of a batch at a time.

``restore`` is the inverse, from output and form alone.

Defined results: a null text counts as empty; empty texts, texts that hold one of the three
signs, and texts that the rate leaves out are plain, which is put out as it is; a null doc_id
draws as the empty string does; rows that repeat doc_id and text have equal results; other
columns aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import prepare, released

SEED = "7"
#: Of a hundred documents, those that are rearranged, and of a hundred of these, those with the suffix first.
RATE = 100
SUFFIX_FIRST = 50
SIGNS = ("<P>", "<S>", "<M>")

#: Bytes of text that DuckDB takes at a time; a longer text is taken alone.
_SLICE = 4 << 20

_SQL = r"""
WITH drawn AS (
  SELECT place, coalesce(body, '') AS body, sha256($seed || ':' || coalesce(id, '')) AS h FROM batch
), cut AS (
  SELECT place, body, regexp_extract_all(body, '[^\n]*\n|[^\n]+') AS lines,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM drawn
), chosen AS (
  SELECT *, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= $rate THEN 'plain'
         WHEN h4 % 100 < $suffix_first THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parted AS (
  SELECT place, n, form, body, array_to_string(list_slice(lines, 1, a), '') AS prefix, array_to_string(list_slice(lines, a + 1, b), '') AS middle,
    array_to_string(list_slice(lines, b + 1, n), '') AS suffix
  FROM chosen
)
SELECT place, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  CASE form WHEN 'plain' THEN body WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END AS output
FROM parted ORDER BY place
"""


def _slices(column):
    """(start, length) of runs of rows of at most ``_SLICE`` bytes of text, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, base + _SLICE, "right")))
        yield start, end - start
        start, base = end, int(ends[end - 1])


def _rearranged(seed: str, rate: int, suffix_first: int):
    def run(batches):
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(":memory:", config={"threads": 1})
        given = {"seed": seed, "rate": rate, "suffix_first": suffix_first}
        for batch in released(batches):
            for start, count in _slices(batch.column(2)):
                part = batch.slice(start, count)
                con.register("batch", pa.table({"place": pa.array(range(count), pa.int64()), "id": part.column(1), "body": part.column(2)}))
                out = con.execute(_SQL, given).to_arrow_table().combine_chunks()
                con.unregister("batch")
                columns = [pa.concat_arrays(out.column(c).chunks) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        con.close()

    return run


def rearrange(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""
    prepare(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("id"), F.col(text).alias("body"))
    return chosen.mapInArrow(_rearranged(seed, rate, suffix_first), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Its parts hold no sign, so that the three signs part it."""
    parts = F.split(output, "|".join(SIGNS), -1)  # what stands before the first sign is empty
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\n]*\n|[^\n]+') AS l, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS d FROM t
), v AS (
  SELECT *, len(l) AS n, list_sort([d[1] % (len(l) + 1), d[2] % (len(l) + 1)]) AS c,
    CASE WHEN x = '' OR regexp_matches(x, '<[PSM]>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), w AS (
  SELECT doc_id, x, n, form, list_aggregate(l[1 : c[1]], 'string_agg', '') AS p, list_aggregate(l[c[1] + 1 : c[2]], 'string_agg', '') AS m,
    list_aggregate(l[c[2] + 1 :], 'string_agg', '') AS s
  FROM v
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(coalesce(p, '')) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(coalesce(m, '')) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM w
"""
