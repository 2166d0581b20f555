"""Jobs: their configuration and identity, blocks, attempts at an outside transform, audits and publishing."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from fnmatch import fnmatch

from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .flow import PRICES


@dataclass(frozen=True)
class JobConfig:
    """What one job covers and how; equal jobs compare equal."""

    source: str
    output: str
    pages: tuple[int, ...] = ()
    model: str = "gpt-5.6-luna"
    concurrency: int = 2
    instructions: str = ""
    chunk_chars: int = 6500
    source_urls: tuple[str, ...] = ()
    chapters: int = 0
    usd_brl: float = 5.13
    memory: str = ""

    def __post_init__(self):
        object.__setattr__(self, "concurrency", min(4, max(1, self.concurrency)))


def check_identity(stored: str | None, config: JobConfig, content_hash: str) -> str:
    """The job's identity as JSON; an error if the folder holds another job."""
    now = json.dumps({"content": content_hash, **asdict(config)}, sort_keys=True)
    if stored is not None and json.loads(stored) != json.loads(now):
        raise ValueError("the folder belongs to another job")
    return now


def contiguous(pages: DataFrame, key: str, page: str = "page") -> DataFrame:
    """key, ok: whether its pages are exactly 1 to their number."""
    p = pages.groupBy(key).agg(F.min(page).alias("a"), F.max(page).alias("b"), F.countDistinct(page).alias("n"))
    return p.select(key, F.coalesce((F.col("a") == 1) & (F.col("b") == F.col("n")), F.lit(False)).alias("ok"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Block files (a JSON object id -> text each) as rows: block (file name), ord, id, text."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").withColumn("block", F.element_at(F.split(F.input_file_name(), "/"), -1))
    raw = raw.where(~F.col("block").rlike(r"\.(meta|usage)\.json$"))
    ids = F.posexplode(F.json_object_keys("value")).alias("ord", "id")
    return raw.select("block", F.from_json("value", "map<string,string>").alias("m"), ids).select("block", "ord", "id", F.element_at("m", F.col("id")).alias("text"))


def block_pairs(sources: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Each source with its target by keys; a missing target is empty."""
    t = targets.select(*keys, F.col("text").alias("_t"))
    return sources.withColumnRenamed("text", "source").join(t, keys, "left").withColumn("target", F.coalesce("_t", F.lit(""))).drop("_t")


def call_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable call record under folder; damaged files are skipped."""
    usage = "struct<input_tokens: long, cached_input_tokens: long, output_tokens: long, reasoning_output_tokens: long>"
    schema = f"created_at string, operation string, model string, usage {usage}, usage_reported boolean, api_equivalent_usd decimal(18,6)"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).withColumn("file", F.input_file_name())


def valid_translation(text: Column, markers: Column) -> Column:
    """At least 20 bytes, and the expected page markers in order."""
    return F.coalesce((F.octet_length(text) >= 20) & (X.expected_markers(text) == markers), F.lit(False))


#: Delimiters around an answer.
DELIMITERS = ("<INICIO_DO_CONTEUDO>", "<FIM_DO_CONTEUDO>")


def sanitize(t: Column) -> Column:
    """Without delimiters, trimmed, with one line end."""
    for tag in DELIMITERS:
        t = F.replace(t, F.lit(tag), F.lit(""))
    return F.concat(X.trimmed(t), F.lit("\n"))


def attempt_rounds(items: DataFrame, transform: Callable[[DataFrame, str], DataFrame], valid: Column, rounds=("first", "second", "single")) -> DataFrame:
    """items (id, source) plus target and attempt: what is not valid goes to the next round; null if none was.

    transform: (items, round) -> (id, target). Each round is cut by checkpoint(), as calls must not be made
    twice; only pending rows go on, so a round costs what is left.
    """
    from .flow import ensure_checkpoints

    ensure_checkpoints(items.sparkSession)
    pending, done = items.checkpoint(), None
    for name in rounds:
        if pending.isEmpty():
            break
        made = pending.join(transform(pending, name), "id", "left").withColumn("_ok", F.coalesce(valid, F.lit(False))).checkpoint()
        good = made.where("_ok").drop("_ok").withColumn("attempt", F.lit(name))
        done = good if done is None else done.unionByName(good)
        pending = made.where(~F.col("_ok")).select(items.columns)
    left = pending.withColumn("target", F.lit(None).cast("string")).withColumn("attempt", F.lit(None).cast("string"))
    return left if done is None else done.unionByName(left)


def reusable(reported: DataFrame, trusted: DataFrame, current: DataFrame) -> DataFrame:
    """ids reported as reused whose value is still trusted and still current: (id) of (id, key), (key, value), (id, value)."""
    return reported.join(trusted, "key").join(current, ["id", "value"], "left_semi").select("id").distinct()


def audit_ids(selected: DataFrame, reused: DataFrame, blocking: DataFrame) -> DataFrame:
    """(selected without reused) and blocking ids, each once."""
    return selected.select("id").join(reused.select("id"), "id", "left_anti").union(blocking.select("id")).distinct()


def assemble(local: DataFrame, semantic: DataFrame, expected: DataFrame, reviewed: DataFrame) -> DataFrame:
    """One row: status, local, semantic and total problems; ids expected but not reviewed (or the reverse) force a review."""
    gap = expected.select("id").exceptAll(reviewed.select("id")).union(reviewed.select("id").exceptAll(expected.select("id")))
    counted = local.select(F.lit("l").alias("k")).union(semantic.select(F.lit("s"))).union(gap.select(F.lit("g")))
    n = lambda k: F.count(F.when(F.col("k") == k, 1))
    total = n("l") + n("s") + F.when(n("g") > 0, 1).otherwise(0)
    return counted.agg(F.when(total > 0, "review").otherwise("approved").alias("status"), n("l").alias("local"), n("s").alias("semantic"), (n("g") == 0).alias("covered"), total.cast("long").alias("problems"))


def divergence(source: DataFrame, final: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key, kind, before, after where counts differ; a missing side counts zero."""
    long = lambda d, name: d.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("long").alias(name)) for k in kinds])).alias("x")).select(key, "x.*")
    both = long(source, "before").join(long(final, "after"), [key, "kind"], "full_outer").na.fill(0, ["before", "after"])
    return both.where("before <> after")


def estimated_cost(model: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """US dollars before a run, without cached input; null for an unknown model."""
    out = F.lit(None).cast("decimal(18,6)")
    for name, (a, _, c) in PRICES.items():
        usd = (input_tokens.cast("decimal(18,0)") * F.lit(a).cast("decimal(10,4)") + output_tokens.cast("decimal(18,0)") * F.lit(c).cast("decimal(10,4)")) / F.lit(1000000).cast("decimal(10,0)")
        out = F.when(model == name, F.round(usd, 6).cast("decimal(18,6)")).otherwise(out)
    return out


def _store(path) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(str(path))


def purge(folder, pattern: str, current: set[str]) -> list[str]:
    """Remove files of an earlier scope from a folder of any store pyarrow opens; gives their names."""
    store, at = _store(folder)
    files = [f for f in store.get_file_info(afs.FileSelector(at, allow_not_found=True)) if f.is_file and fnmatch(f.base_name, pattern) and f.base_name not in current]
    for f in files:
        store.delete_file(f.path)
    return sorted(f.base_name for f in files)


#: The folders of a project.
FOLDERS = ("01_original", "02_trabalho", "03_entrega_atual", "04_relatorios")


def publish(root, original, delivery: list, reports: dict[str, dict]) -> dict:
    """A project's four folders: the original, what is delivered, and reports as JSON; gives project.json's content.

    Paths are local or URIs of any store pyarrow opens. An original that is there with the same hash stays.
    """
    store, at = _store(root)
    name = lambda p: str(p).rstrip("/").rsplit("/", 1)[-1]
    for f in FOLDERS:
        store.create_dir(f"{at}/{f}", recursive=True)

    def digest(fs, path) -> str:
        with fs.open_input_stream(path) as stream:
            h = hashlib.sha256()
            while block := stream.read(1 << 20):
                h.update(block)
        return h.hexdigest()

    def copy(p, folder: str) -> None:
        source, to = _store(p), f"{at}/{folder}/{name(p)}"
        if folder != FOLDERS[0] or not store.get_file_info(to).is_file or digest(store, to) != digest(*source):
            afs.copy_files(source[1], to, source_filesystem=source[0], destination_filesystem=store)

    def put(path: str, content: dict) -> None:
        with store.open_output_stream(f"{at}/{path}") as out:
            out.write(json.dumps(content, ensure_ascii=False, indent=2).encode())

    copy(original, FOLDERS[0])
    for p in delivery:
        copy(p, FOLDERS[2])
    for k, report in reports.items():
        put(f"{FOLDERS[3]}/{k}.json", report)
    project = {"original": name(original), "delivery": sorted(map(name, delivery)), "reports": sorted(reports)}
    put("project.json", project)
    return project
