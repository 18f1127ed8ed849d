"""Documents kept as one Markdown file each: a YAML head between --- lines, then the body."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = ("authors", "supervisors", "keywords", "oai_sets")
TEXTS = ("handle", "title", "date", "abstract_pt", "abstract_en", "source_url", "rights")
SCHEMA = ", ".join([*[f"{c} string" for c in TEXTS], *[f"{c} array<string>" for c in LISTS], "full_text boolean", "body string", "path string", "sha string"])


def _scalar(s: str) -> str:
    s = s.strip()
    if len(s) >= 2 and s[0] == s[-1] and s[0] in "\"'":
        inner = s[1:-1]
        return inner.replace('\\"', '"').replace("\\\\", "\\") if s[0] == '"' else inner.replace("''", "'")
    return s


def split_front_matter(text: str) -> tuple[dict, str] | None:
    """The head as a flat mapping (texts, lists of texts, folded blocks) and the body; None without a head."""
    parts = text.split("---\n", 2)
    if len(parts) < 3 or parts[0].strip():
        return None
    head: dict = {}
    key, block = None, None
    for line in parts[1].split("\n"):
        if block is not None and (line.startswith("  ") or not line.strip()):
            block.append(line.strip())
            head[key] = " ".join(block).strip()
            continue
        block = None
        item = re.match(r"^\s*-\s+(.*)$", line)
        pair = re.match(r"^([A-Za-z_]\w*):\s*(.*)$", line)
        if item and key is not None and not pair:
            if not isinstance(head.get(key), list):
                head[key] = []
            head[key].append(_scalar(item[1]))
        elif pair:
            key, value = pair[1], pair[2].strip()
            if value in ("|", ">", "|-", ">-"):
                block, head[key] = [], ""
            elif value.startswith("[") and value.endswith("]"):
                head[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()]
            else:
                head[key] = _scalar(value) if value else None
        elif line.startswith("  ") and isinstance(head.get(key), str):
            head[key] += " " + line.strip()
    return head, parts[2]


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with a head; each file is one row of the scan, so large corpora are spread by file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.sha2("value", 256).alias("sha"))
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, text, sha in zip(b["path"], b["value"], b["sha"]):
                got = split_front_matter(text or "")
                if got:
                    head, body = got
                    lists = [x if isinstance(x := head.get(c), list) else [x] if x else [] for c in LISTS]
                    texts = [x if (x := head.get(c)) is None or isinstance(x, str) else ", ".join(x) for c in TEXTS]
                    rows.append([*texts, *lists, str(head.get("full_text")).lower() == "true", body.replace("\x00", "").strip(), p, sha])
            yield pd.DataFrame(rows, columns=names)

    return raw.mapInPandas(parse, SCHEMA)


def body_of(raw: Column) -> Column:
    """What follows the head, without leading line breaks; all of it where there is no head or none that ends."""
    end = F.locate("\n---\n", raw, 5)
    return F.when(~raw.startswith("---\n") | (end == 0), raw).otherwise(F.ltrim(F.substring(raw, end + 5, F.length(raw)), F.lit("\n")))


def read_bodies(spark: SparkSession, folder: str, handles: list[str]) -> DataFrame:
    """handle and body of the handles asked for, body null where there is no file. Only their files are looked up and read: a
    handle names its file (slashes as hyphens), so no listing of the corpus is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    asked = list(dict.fromkeys(handles))
    paths = {h: f"{folder.rstrip('/')}/{h.replace('/', '-')}.md" for h in asked}
    there = [p for p in paths.values() if hadoop.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(p))]
    want = spark.createDataFrame([(h, p.rsplit("/", 1)[1]) for h, p in paths.items()], "handle string, file string")
    if not there:
        return want.select("handle", F.lit(None).cast("string").alias("body"))
    raw = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_name").alias("file"), body_of(F.col("value")).alias("body"))
    return want.join(raw, "file", "left").select("handle", "body")


def theses(corpus: DataFrame) -> DataFrame:
    return corpus.select("handle", F.replace("handle", F.lit("/"), F.lit("-")).alias("slug"), "title", "date", F.nullif(F.substring("date", 1, 4), F.lit("")).alias("year"), "source_url", "rights", "full_text", "abstract_pt", "abstract_en")


def thesis_keywords(corpus: DataFrame) -> DataFrame:
    return corpus.select("handle", F.posexplode("keywords").alias("ordinal", "keyword"))


def thesis_sets(corpus: DataFrame) -> DataFrame:
    return corpus.select("handle", F.explode(F.array_distinct("oai_sets")).alias("set_spec"))


def mentions(corpus: DataFrame) -> DataFrame:
    """handle, name_raw, role, ordinal."""
    def of(column: str, role: str) -> DataFrame:
        return corpus.select("handle", F.posexplode(column).alias("ordinal", "name_raw")).withColumn("role", F.lit(role))

    return of("authors", "author").unionByName(of("supervisors", "supervisor"))


def reconcile(corpus: DataFrame, manifest: DataFrame) -> None:
    """Both hold the same handles, or an error names some that differ."""
    a, b = corpus.select("handle").distinct(), manifest.select("handle").distinct()
    odd = a.join(b, "handle", "left_anti").withColumn("where", F.lit("not in manifest")).unionByName(b.join(a, "handle", "left_anti").withColumn("where", F.lit("no file"))).limit(10).collect()
    if odd:
        raise ValueError("; ".join(f"{r['handle']}: {r['where']}" for r in odd))
