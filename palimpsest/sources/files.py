"""File sources: watched folders, change detection, corpus aggregation, combined texts, backups, snapshots, web pages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

WATCHED = ("md", "txt", "yaml")
# Text extensions of the older watcher.
WATCHED_WIDE = ("md", "txt", "yaml", "yml", "json", "csv", "py", "js", "ts", "html", "css", "sh", "log")
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, root: str, extensions: Sequence[str] = WATCHED, most_bytes: int | None = None) -> DataFrame:
    """(path, modified, bytes, content): text files below a folder; dotfiles, mirrored and empty files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(extensions)}}}").load(root)
    keep = (F.col("length") > 0) & ~F.col("path").rlike(r"/\.|/mirrored_brain/")
    if most_bytes:
        keep &= F.col("length") <= most_bytes
    return as_texts(raw.where(keep))


def read_wide(spark: SparkSession, root: str) -> DataFrame:
    """What the older watcher took in: more kinds of text, up to 10 MB a file."""
    return read_files(spark, root, WATCHED_WIDE, 10 << 20)


def as_texts(raw: DataFrame) -> DataFrame:
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.sha2(F.col("content"), 256).alias("hash"), F.col("content").cast("string").alias("content"))


def changed(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose hash isn't the last one registered for their path. ``registry``: (path, hash, last_ingest); the latest row of a path counts."""
    last = registry.groupBy("path").agg(F.max_by("hash", "last_ingest").alias("hash"))
    return files.join(last, ["path", "hash"], "left_anti")


def latest_versions(files: DataFrame) -> DataFrame:
    w = Window.partitionBy("path").orderBy(F.desc("modified"), F.desc("hash"))
    return files.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def bucketed(files: DataFrame, root: str = "") -> DataFrame:
    rel = F.regexp_replace("path", f"^(file:)?/*{re.escape(root.strip('/'))}/*" if root else r"^(file:)?/+", "")
    return files.withColumns({"rel_path": rel, "bucket": X.path_bucket(rel), "provenance": X.watch_provenance(rel)})


def head_and_tail(c: Column, most_lines: int = 5000) -> Column:
    """Long files keep their first and last halves of the allowed lines."""
    lines, half = F.split(c, "\n"), most_lines // 2
    cut = F.concat(F.slice(lines, 1, half), F.array(F.lit("... [cut] ...")), F.slice(lines, F.size(lines) - half + 1, half))
    return F.when(F.size(lines) > most_lines, F.array_join(cut, "\n")).otherwise(c)


def corpus(spark: SparkSession, root: str, include: Sequence[str], exclude_dirs: Sequence[str] = ("node_modules", ".git", "dist"), token_cap: int = 1_000_000, most_bytes: int = 5 << 20) -> DataFrame:
    """Files of a tree in order of path until the token total would pass the cap; a file that doesn't fit is passed over.

    The fold is over (path, tokens) only, on the driver's file listing; contents stay in the cluster."""
    files = read_files(spark, root, include, most_bytes)
    if exclude_dirs:
        files = files.where(~F.col("path").rlike("/(" + "|".join(re.escape(d) for d in exclude_dirs) + ")/"))
    files = files.withColumn("content", head_and_tail(F.col("content"))).withColumn("tokens", X.word_token_estimate(F.col("content")))
    taken, total = [], 0
    for r in files.select("path", "tokens").orderBy("path").toLocalIterator():
        if total + r.tokens <= token_cap:
            total += r.tokens
            taken.append((r.path,))
    return files.join(spark.createDataFrame(taken, "path string"), "path", "left_semi")


def split_combined(df: DataFrame, text: str = "content") -> DataFrame:
    """(path, content) of the files in combined texts."""
    p = r"(?s)--- START OF FILE: (.*?) ---\n(.*?)\n?--- END OF FILE"
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias("path"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(2)).alias("content"))
    return df.select(F.explode(both).alias("f")).select("f.path", "f.content")


def squashed(files: DataFrame) -> DataFrame:
    """(folder, content): session files of each folder as one text, in order of the number in their names, then of path."""
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = files.select(folder.alias("folder"), F.struct(session_order(name).alias("n"), "path", "content").alias("r"))
    return rows.groupBy("folder").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("folder", F.array_join("rs.content", "\n\n").alias("content"))  # one text a folder is what is asked for


def session_order(path: Column) -> Column:
    """The number in a session file's name; files without one come last."""
    return F.coalesce(F.regexp_extract(path, r"(?i)sessions?_part_(\d+)", 1).try_cast("int"), F.lit(999_999))


def normalised_records(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Records of different shapes as (id, ts, content): the first known name of each field counts."""
    pick = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string"))
    return df.select(pick("id", "uid", "uuid").alias("id"), X.flexible_timestamp(pick("timestamp", "created_at")).alias("ts"), F.substring(pick("content", "text", "body"), 1, most).alias("content"))


def search_files(files: DataFrame, glob: str, needle: str, k: int) -> DataFrame:
    """Files whose name fits the glob and whose content holds the text, with a snippet around it."""
    name = "(^|/)" + re.escape(glob).replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    at = F.locate(needle, F.col("content"))
    hit = files.where(F.col("path").rlike(name) & (at > 0))
    return hit.orderBy("path").limit(k).select("path", F.substring(F.col("content"), F.greatest(F.lit(1), at - 40), F.lit(80 + len(needle))).alias("snippet"))


def import_yaml(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, counts by status) of a YAML list of records: imported, skipped (no content) or errors (no mapping). Small files, read on the driver."""
    import json

    try:
        import yaml

        items = yaml.safe_load(text) or []
    except ImportError:
        items = flat_yaml(text)
    rows = []
    for x in items if isinstance(items, list) else []:
        if not isinstance(x, dict):
            rows.append(("error", None, None, None))
        else:
            c = x.get("content")
            rows.append(("imported" if c else "skipped", c and str(c), str(x.get("source", "")), json.dumps(x, default=str)))
    df = spark.createDataFrame(rows, "status string, content string, source string, record string")
    return df, df.groupBy("status").agg(F.count("*").alias("n"))


def flat_yaml(text: str) -> list:
    """A list of flat mappings with plain or quoted scalars: what snapshots hold."""
    import json

    out: list = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        item = re.match(r"^- (.*)$", line)
        pair = re.match(r"^\s*([\w-]+):\s*(.*)$", item[1] if item else line)
        if item:
            out.append({} if pair else item[1])
        if pair and out and isinstance(out[-1], dict):
            v = pair[2].strip()
            if v[:1] == '"' and v[-1:] == '"' and len(v) > 1:
                v = json.loads(v)
            elif v[:1] == "'" and v[-1:] == "'" and len(v) > 1:
                v = v[1:-1].replace("''", "'")
            out[-1][pair[1]] = v
    return out


# --- web pages ------------------------------------------------------------------------------------------


class _Page(HTMLParser):
    SKIP = {"script", "style", "noscript", "template"}
    CHROME = {"nav", "header", "footer", "aside", "form", "iframe"}
    BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "br", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "title", "td", "th"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.description = "", ""
        self.depth = {"skip": 0, "chrome": 0, "main": 0, "article": 0, "title": 0}
        self.all: list[str] = []
        self.plain: list[str] = []
        self.parts: dict[str, list[str]] = {"main": [], "article": [], "body": []}

    def _zone(self, tag: str) -> str | None:
        return "skip" if tag in self.SKIP else "chrome" if tag in self.CHROME else tag if tag in ("main", "article", "title") else None

    def _put(self, s: str) -> None:
        if not self.depth["chrome"]:
            for z in ("main", "article"):
                if self.depth[z]:
                    self.parts[z].append(s)
            self.parts["body"].append(s)

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if z := self._zone(tag):
            self.depth[z] += 1
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or "").lower() == "description":
            self.description = a.get("content") or ""
        mark = "\n" + "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "\n- " if tag == "li" else "\n" if tag in self.BLOCK else ""
        if mark:
            self._put(mark)
            self.plain.append(" ")

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if (z := self._zone(tag)) and self.depth[z]:
            self.depth[z] -= 1
        if tag in self.BLOCK:
            self._put("\n")
            self.plain.append(" ")

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if self.depth["skip"]:
            return
        if self.depth["title"]:
            self.title += data
            return
        self.plain.append(data)
        self._put(re.sub(r"\s+", " ", data))


def parse_page(html: str | None) -> dict[str, str]:
    """title, description, plain text and Markdown of a page; script and style contents never come out."""
    p = _Page()
    try:
        p.feed(html or "")
        p.close()
    except Exception:  # noqa: BLE001 - broken markup: what was read so far counts
        pass
    body = next((x for z in ("main", "article", "body") if (x := "".join(p.parts[z]).strip())), "")
    md = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]*\n[ \t]*", "\n", body)).strip()
    return {"title": " ".join(p.title.split()), "description": unescape(p.description).strip(), "text": " ".join("".join(p.plain).split()), "markdown": md}


PAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "description", "text", "markdown")])


@F.pandas_udf(PAGE)
def page(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(h) for h in html], columns=PAGE.names)


def research_notes(pages: DataFrame, category: str) -> DataFrame:
    """(url, note): pages as Markdown with front matter."""
    p = pages.withColumn("p", page("html"))
    front = F.concat(F.lit("---\ntitle: "), F.col("p.title"), F.lit("\nurl: "), F.coalesce("url", F.lit("")), F.lit(f"\ncategory: {category}\ndescription: "), F.col("p.description"), F.lit("\n---\n\n"), F.col("p.markdown"))
    return p.select("url", front.alias("note"))


def redirect_target(url: Column) -> Column:
    """The real address in a search result's redirect link."""
    return F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("QUERY"), F.lit("uddg"))), url)


# --- backups --------------------------------------------------------------------------------------------


def write_backup(tables: dict[str, DataFrame], path: str, keys: dict[str, str]) -> DataFrame:
    """Each table as ordered JSON lines below ``path``; gives the counts."""
    from ..operators.stats import table_counts

    for name, df in tables.items():
        df.orderBy(keys[name]).write.mode("overwrite").json(f"{path}/{name}")
    return table_counts(tables)


def read_backup(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(s).json(f"{path}/{name}") for name, s in schemas.items()}


def list_newest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files by time of change, newest first."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes")).orderBy(F.desc("modified"), "path")


def hydrated(current: DataFrame, root: str) -> DataFrame:
    """The table as it is, or, if it is empty, the rows of the newest YAML snapshot below ``root`` (columns the snapshot lacks are null)."""
    spark = current.sparkSession
    if not current.isEmpty() or (path := newest_snapshot(spark, root)) is None:
        return current
    text = spark.read.text(path, wholetext=True).first().value  # a snapshot is one file, read whole
    rows, _ = import_yaml(spark, text)
    got = rows.where("status = 'imported'")
    return got.select(*[F.get_json_object("record", f"$.{f.name}").cast(f.dataType).alias(f.name) for f in current.schema.fields])


def newest_snapshot(spark: SparkSession, root: str) -> str | None:
    """Path of the latest YAML snapshot."""
    got = list_newest(spark, root, "*.yaml").limit(1).collect()
    return got[0].path if got else None


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def yaml_lines(rows: Iterator[dict]) -> Iterator[str]:
    """A snapshot's lines: a list of flat mappings, values in double quotes."""
    import json

    for r in rows:
        for i, (k, v) in enumerate(r.items()):
            yield f"{'- ' if not i else '  '}{k}: {json.dumps('' if v is None else str(v), ensure_ascii=True)}"


def indent_format(x, depth: int = 0) -> str:  # noqa: ANN001
    """Nested values as indented lines."""
    pad = "  " * depth
    if isinstance(x, dict):
        return "\n".join(f"{pad}{k}:\n{indent_format(v, depth + 1)}" if isinstance(v, dict | list) and v else f"{pad}{k}: {v}" for k, v in x.items())
    if isinstance(x, list):
        return "\n".join(f"{pad}-\n{indent_format(v, depth + 1)}" if isinstance(v, dict | list) else f"{pad}- {v}" for v in x)
    return f"{pad}{x}"
