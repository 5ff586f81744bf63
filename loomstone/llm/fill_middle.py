"""Fill-in-the-middle transformation by DuckDB SQL over Arrow batches.

A text is cut into units (code points unless told otherwise), two cuts drawn from a hash of the document's key split them
into prefix, middle and suffix, and the parts are written in another order behind marks, so that a model learns to fill the
middle. Most texts become ``psm`` (prefix, suffix, middle), some ``spm`` (suffix, prefix, middle), the rest stay ``plain``.

Each Arrow batch is registered as a table of an in-memory DuckDB database within the task; ``regexp_extract_all`` cuts,
``list_slice`` and ``array_to_string`` form the parts, ``sha256`` draws, and the result goes back as Arrow: no Python runs per row.
A list of units takes 16 bytes or more a unit, so a batch goes through in runs of rows of ``RUN_BYTES`` of text at most
(a longer text is a run of its own). A row depends on its own key and text only: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from .scratch import bound_batches

#: A unit: one code point, line ends included.
CODE_POINT = "(?s)."
#: Bytes of text whose units are held at once.
RUN_BYTES = 1 << 20
#: What can be asked for, with its type in DuckDB and in Spark.
KINDS = {
    "n": ("BIGINT", "long"),
    "form": ("VARCHAR", "string"),
    "prefix_chars": ("BIGINT", "long"),
    "middle_chars": ("BIGINT", "long"),
    "output": ("VARCHAR", "string"),
    "restored": ("VARCHAR", "string"),
    "output_sha256": ("VARCHAR", "string"),
    "restored_sha256": ("VARCHAR", "string"),
}
DIGEST = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def batch_sql(want: tuple[str, ...], unit: str, seed: int, plain_from: int, spm_below: int, marks: tuple[str, str, str]) -> str:
    """DuckDB SQL from a table ``batch`` (key VARCHAR, text VARCHAR, neither null) to the wanted columns, a row per row in its order."""
    p, s, m = map(_quoted, marks)
    share = lambda i: f"CAST(CAST('0x' || substr(h, {8 * i + 1}, 8) AS UINTEGER) AS BIGINT)"
    # Units that leave something out can't be put together again; code points never do.
    whole = "" if unit == CODE_POINT else "OR array_to_string(u, '') <> text"
    columns = ", ".join(f"CAST({c} AS {KINDS[c][0]}) AS {c}" for c in want)
    return f"""
    WITH cut AS (SELECT text, regexp_extract_all(text, {_quoted(unit)}) AS u, sha256('{seed}:' || key) AS h FROM batch),
    drawn AS (SELECT text, u, len(u) AS n, {share(0)} AS h1, {share(1)} AS h2, {share(2)} AS h3, {share(3)} AS h4 FROM cut),
    formed AS (
        SELECT text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN n = 0 OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR h3 % 100 >= {plain_from} {whole} THEN 'plain'
                WHEN h4 % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form
        FROM drawn),
    parts AS (
        SELECT text, n, a, b, form,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix
        FROM formed),
    written AS (
        SELECT n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            CASE form WHEN 'plain' THEN text WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output
        FROM parts),
    marked AS (
        SELECT *, CASE form WHEN 'psm' THEN {s} WHEN 'spm' THEN {p} END AS second FROM written),
    placed AS (
        SELECT *, strpos(output, second) AS at2, strpos(output, {m}) AS at3 FROM marked),
    apart AS (
        SELECT *, substr(output, length({p}) + 1, at2 - 1 - length({p})) AS one, substr(output, at2 + length(second), at3 - at2 - length(second)) AS two, substr(output, at3 + length({m})) AS three
        FROM placed),
    restored AS (
        SELECT *, CASE form WHEN 'plain' THEN output WHEN 'psm' THEN one || three || two ELSE two || three || one END AS restored FROM apart),
    digested AS (SELECT *, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM restored)
    SELECT {columns} FROM digested"""


def _runs(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``RUN_BYTES`` at most, or of one row."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + RUN_BYTES, side="right")))
        yield at, to
        at = to


def transformed(
    docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "fim", want: tuple[str, ...] = ("n", "form", "prefix_chars", "middle_chars", "output"),
    unit: str = CODE_POINT, seed: int = 1, plain_from: int = 90, spm_below: int = 20, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"),
) -> DataFrame:
    """``docs`` with a struct column ``into`` (in place of one of that name) of what is wanted among ``KINDS``.

    The draws are the first four groups of eight digits of the SHA-256 of ``seed:key`` in decimal, so equal keys get equal
    draws, and a null key counts as the empty string. A null text counts as empty. Empty texts, texts that contain a mark,
    those whose units leave out some of the text, and a share of 100 - ``plain_from`` per cent stay plain, without part
    lengths; of the rest, ``spm_below`` per cent are spm. ``n`` counts units, ``prefix_chars`` and ``middle_chars`` code
    points. Marks must be alike in length, and no mark's end may begin another. An empty table gives no rows; repeated
    rows give repeated rows; other columns of any name and type are carried beside DuckDB, not through it.
    """
    if len({*map(len, marks)}) != 1 or len({*marks}) != 3 or any(a.endswith(b[:i]) for a in marks for b in marks for i in range(1, len(b))):
        raise ValueError("marks must be three strings of one length, none of whose ends begins a mark")
    bound_batches(docs.sparkSession)
    sql = batch_sql(want, unit, seed, plain_from, spm_below, marks)
    carried = [c for c in docs.columns if c != into]
    tick = lambda c: F.col("`" + c.replace("`", "``") + "`")
    named = docs.select(
        *(tick(c).alias(f"c{i}") for i, c in enumerate(carried)), F.coalesce(tick(key).cast("string"), F.lit("")).alias("key"), F.coalesce(tick(text), F.lit("")).alias("text")
    )
    out = [f"c{i}" for i in range(len(carried))]
    wanted = ", ".join(f"{c}: {KINDS[c][1]}" for c in want)
    schema = named.select(*out, F.lit(None).cast(f"struct<{wanted}>").alias("fim")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1})
        try:
            for batch in batches:
                given = pa.table({"key": batch["key"], "text": batch["text"]})
                for at, to in _runs(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False)):
                    con.register("batch", given.slice(at, to - at))
                    made = con.sql(sql).to_arrow_table().combine_chunks()
                    con.unregister("batch")
                    fim = pa.StructArray.from_arrays([made[c].combine_chunks() for c in want], names=list(want))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in out), fim], names=[*out, "fim"])
        finally:
            con.close()

    made = named.mapInArrow(run, schema)
    return made.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), F.col("fim").alias(into))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, part lengths and digests of the transformed and the restored text of every document, one row per row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return transformed(docs, want=DIGEST).select("doc_id", "fim.*")


#: The same rows by substrings in place of lists of units.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
    SELECT *, CAST(length(text) AS BIGINT) AS n, CAST(CAST('0x' || h[1:8] AS UINTEGER) AS BIGINT) AS h1, CAST(CAST('0x' || h[9:16] AS UINTEGER) AS BIGINT) AS h2,
        CAST(CAST('0x' || h[17:24] AS UINTEGER) AS BIGINT) % 100 AS h3, CAST(CAST('0x' || h[25:32] AS UINTEGER) AS BIGINT) % 100 AS h4
    FROM d),
f AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM k),
o AS (
    SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM o"""
