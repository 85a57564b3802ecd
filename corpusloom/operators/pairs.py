"""Documentation/function pairs from Java sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import comment_kind, comments, strip_comments
from corpusloom.operators import java

#: Methods of an output batch, in bytes of their text.
BATCH_BYTES = 4 << 20


def methods_with_docs(files: DataFrame, code: str = "code") -> DataFrame:
    """``(…, method_no, doc, code)``: every method of every Java file with the doc comment before it, else after it.

    Nested brackets cannot be matched by a regular expression, so each file is walked once in an Arrow batch. What is found is
    handed on in batches of bounded size, however many methods a file has. A null source has no methods.
    """
    keep = [c for c in files.columns if c != code]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name != code]

    def batch_of(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        rows, *columns = zip(*found, strict=True) if found else [()] * 4
        kinds = (pa.int32(), pa.string(), pa.string())
        kept = batch.select(keep).take(pa.array(rows, pa.int64()))
        made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keep, "method_no", "doc", "code"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size = [], 0
            for row, cell in enumerate(batch.column(code)):
                source = cell.as_py() or ""
                for number, m in enumerate(java.methods(source)):
                    doc = next((c for c in (m.before, m.after) if c and java.is_doc(c)), None)
                    found.append((row, number, doc, source[m.start : m.end]))
                    size += m.end - m.start + len(doc or "")
                    if size > BATCH_BYTES:
                        yield batch_of(batch, found)
                        found, size = [], 0
            yield batch_of(batch, found)

    return files.mapInArrow(walk, ", ".join([*fields, "method_no int", "doc string", "code string"]))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def doc_text(doc: Column) -> Column:
    """A doc comment without its marks."""
    inner = F.regexp_replace(doc, r"^/\*+|\*+/$", "")
    lines = F.transform(F.split(inner, "\n"), lambda line: _bare(F.regexp_replace(line, r"^\s*\*+", "")))
    return _bare(F.array_join(lines, "\n"))


def doc_summary(doc: Column) -> Column:
    """The first paragraph, up to the first tag."""
    return _bare(F.get(F.split(doc_text(doc), r"\n\s*\n|@", 2), F.lit(0)))


def doc_tokens(summary: Column) -> Column:
    return F.regexp_extract_all(summary, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def doc_elements(methods: DataFrame) -> DataFrame:
    """Documented methods as ``(…, docstring_tokens, docstring_summary, function)``."""
    summary = doc_summary(F.col("doc"))
    return (
        methods.where(F.col("doc").isNotNull())
        .withColumn("docstring_summary", summary)
        .withColumn("docstring_tokens", doc_tokens(F.col("docstring_summary")))
        .where(F.size("docstring_tokens") > 0)
        .withColumnRenamed("code", "function")
        .drop("doc")
    )


def language_pairs(elements: DataFrame, detected: str, wanted: str, code_language: str = "java") -> DataFrame:
    """Elements whose documentation is in the wanted language, their code stripped of comments."""
    return elements.where(F.col(detected) == wanted).withColumn(
        "function", strip_comments(F.col("function"), code_language)
    )


def comment_inventory(files: DataFrame, code: str = "code") -> DataFrame:
    """Number and size of comments by kind."""
    found = files.select(F.explode(comments(F.col(code))).alias("comment"))
    return found.groupBy(comment_kind(F.col("comment")).alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.length("comment")).alias("chars")
    )
