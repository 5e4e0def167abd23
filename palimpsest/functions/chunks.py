"""Chunkers that need a scan of the text, in Arrow batches; and JSON in running text."""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_SENTENCE = re.compile(r"[^.!?。！？…\n]*(?:[.!?。！？…]+[\s\"')\]]*|\n+|$)")
#: Fixed order of the places where a simple chunk may break, best first.
BREAKS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", " ")


#: Characters of chunks that leave a task together.
AT_ONCE = 4_000_000


def sentences(text: str) -> list[str]:
    """Pieces whose concatenation is the text."""
    return [m for m in _SENTENCE.findall(text) if m]


def paragraph_chunks(text: str, most: int) -> list[str]:
    """Whole sentences up to `most` words a chunk, ended at paragraph ends; a longer sentence is a chunk of its own.  Lossless."""
    out, held, n = [], "", 0
    for s in sentences(text):
        words = len(s.split())
        if held and n + words > most:
            out.append(held)
            held, n = "", 0
        held += s
        n += words
        if s.endswith("\n\n"):
            out.append(held)
            held, n = "", 0
    return out + [held] if held else out


def simple_chunks(text: str, size: int, overlap: int, tails: bool = True) -> list[str]:
    """At most size characters, ended behind the last separator of the best kind there is, stripped; neighbours overlap.

    With tails, the overlap at the end of the text is given again and again, a character shorter each time.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            places = ((text.rfind(b, start, end), len(b)) for b in BREAKS)
            end = next((at + n for at, n in places if at >= 0), end)
        if piece := text[start:end].strip():
            out.append(piece)
        if end == len(text) and not tails:
            break
        start = max(start + 1, end - overlap)
    return out


_SPACE, _VARIANT = uuid.NAMESPACE_OID.bytes, {c: "89ab"[i & 3] for i, c in enumerate("0123456789abcdef")}


def chunk_id(chunk: str) -> str:
    """str(uuid.uuid5(uuid.NAMESPACE_OID, chunk)), without the objects between."""
    h = hashlib.sha1(_SPACE + chunk.encode(), usedforsecurity=False).hexdigest()
    return f"{h[:8]}-{h[8:12]}-5{h[13:16]}-{_VARIANT[h[16]]}{h[17:20]}-{h[20:32]}"


def _numbered(pieces: list[str]):
    for i, c in enumerate(pieces):
        yield i, chunk_id(c), c


def _frames(parts, key: str, text: str, cut, at_once: int = AT_ONCE):
    """The chunks of each batch of texts, in frames of about `at_once` characters."""
    columns = [key, "chunk", "chunk_id", "chunk_text"]
    for pdf in parts:
        rows, held = [], 0
        for k, t in zip(pdf[key], pdf[text], strict=True):
            for piece in _numbered(cut(t or "")):
                rows.append((k, *piece))
                held += len(piece[-1]) + 200  # what a row takes besides
                if held > at_once:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)


def _exploded(df: DataFrame, key: str, text: str, cut) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(lambda parts: _frames(parts, key, text, cut), f"{key} {kind}, chunk int, chunk_id string, chunk_text string")


def paragraphs(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    return _exploded(df, key, text, lambda t: paragraph_chunks(t, most))


def simple(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    return _exploded(df, key, text, lambda t: simple_chunks(t, size, overlap))


_CHUNK = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("chunk_id", T.StringType()), T.StructField("chunk_text", T.StringType())])


def _checked(text: AnalyzeArgument, **numbers: AnalyzeArgument) -> AnalyzeResult:
    """The generators' schema; a text that is none, or a size that is no fixed number over 0, is refused before anything runs."""
    if not isinstance(text.dataType, T.StringType | T.NullType):
        raise ValueError("the first argument must be a string")
    for name, n in numbers.items():
        if not n.isConstantExpression or not isinstance(n.value, int) or n.value < (0 if name == "overlap" else 1):
            raise ValueError(f"{name} must be a whole number, given as a constant")
    return AnalyzeResult(schema=_CHUNK)


class ParagraphChunks:
    """paragraph_chunks(text, most): a row a chunk, for LATERAL joins."""

    @staticmethod
    def analyze(text: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        return _checked(text, most=most)

    def eval(self, text: str | None, most: int):
        yield from _numbered(paragraph_chunks(text or "", most))


class SimpleChunks:
    """simple_chunks(text, size, overlap)."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument, overlap: AnalyzeArgument) -> AnalyzeResult:
        return _checked(text, size=size, overlap=overlap)

    def eval(self, text: str | None, size: int, overlap: int):
        yield from _numbered(simple_chunks(text or "", size, overlap))


def register_generators(spark: SparkSession) -> None:
    """Makes the chunkers table functions of the session's SQL: FROM docs, LATERAL paragraph_chunks(text, 120)."""
    spark.udtf.register("paragraph_chunks", F.udtf(ParagraphChunks))
    spark.udtf.register("simple_chunks", F.udtf(SimpleChunks))


def markdown_sections(text: Column) -> Column:
    """Sections of a text at its # headers, each with its header."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,6} )"), lambda s: F.trim(s) != "")


def first_balanced(text: str | None) -> str | None:
    """The first {...} with balanced braces outside strings; an unclosed one is closed."""
    if not text or (start := text.find("{")) < 0:
        return None
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            continue
        if c == '"':
            quoted, escaped = True, False
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return text[start:] + ('"' if quoted else "") + "}" * depth


def balanced_json(c: Column) -> Column:
    @F.pandas_udf("string")
    def find(s: pd.Series) -> pd.Series:
        return s.map(first_balanced)

    return find(c)


def keep_informative(words: Column, word: str, score: str, share: float) -> Column:
    """Words (structs in order) whose score is at least the share-quantile of the row's scores, space-joined."""
    scores = F.array_sort(F.transform(words, lambda w: w[score]))
    at = F.greatest(F.ceil(F.size(scores) * F.lit(share)), F.lit(1)).cast("int") - 1
    bar = F.transform(F.array(scores), lambda s: F.get(s, at))
    return F.array_join(F.transform(F.filter(words, lambda w: w[score] >= F.get(bar, 0)), lambda w: w[word].cast("string")), " ")
