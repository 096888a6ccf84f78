"""Jobs as data: which stages can run, what changed since a run, how long it will take, and what is left over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Stages of a run: name, lane, stages that have to be done before. Each is a table written before the next one begins.
STAGES = (
    ("decode", "geometry", ()),
    ("pack", "geometry", ("decode",)),
    ("tracking", "geometry", ("pack",)),
    ("pose_refinement", "geometry", ("tracking",)),
    ("registered", "geometry", ("pose_refinement",)),
    ("geometry", "geometry", ("registered",)),
    ("photos", "color", ()),
    ("masks", "color", ("photos",)),
    ("cameras", "color", ("photos", "pose_refinement")),
    ("candidates", "color", ("geometry", "cameras", "masks")),
    ("global", "color", ("candidates",)),
    ("local", "color", ("global",)),
    ("blend", "color", ("local",)),
    ("export", "color", ("blend",)),
)


def planned(mode: str = "run", mask: bool = True, exposure: bool = True) -> list[str]:
    """Stages of a job by its options."""
    names = [n for n, _, _ in STAGES]
    if mode == "build":
        names = names[: names.index("geometry") + 1]
    elif mode == "colorize":
        names = [n for n in names if n in ("masks", "candidates", "global", "local", "blend", "export")]
    return [n for n in names if (mask or n != "masks") and (exposure or n not in ("global", "local"))]


def ready(names: Sequence[str], done: set[str], running: set[str]) -> list[str]:
    """The first stage of each idle lane whose dependencies, as far as they are planned, are done."""
    busy = {lane for n, lane, _ in STAGES if n in running}
    out: list[str] = []
    for n, lane, before in STAGES:
        if n in names and n not in done and n not in running and lane not in busy and all(b in done or b not in names for b in before):
            out.append(n)
            busy.add(lane)
    return out


def ready_table(stages: DataFrame, needs: DataFrame, done: DataFrame) -> DataFrame:
    """The same for tables: stages (name) without an unmet row of needs (name, before)."""
    unmet = needs.join(done.withColumnRenamed("name", "before"), "before", "left_anti").select("name").distinct()
    return stages.join(done, "name", "left_anti").join(unmet, "name", "left_anti")


def ready_lanes(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """(run, lane, stage): of each run the first stage of each lane that is not done and whose stages before are.

    runs(run, done: array of stages, null for none), stages(k, stage, lane, before: array), of which there are a few.
    """
    done = F.coalesce("done", F.array().cast("array<string>"))
    open_ = runs.crossJoin(F.broadcast(stages)).where(~F.array_contains(done, F.col("stage")) & (F.size(F.array_except("before", done)) == 0))  # a few stages
    return open_.groupBy("run", "lane").agg(F.min(F.struct("k", "stage"))["stage"].alias("stage"))


def changed_keys(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys whose values differ between two tables (key, value), missing ones included."""
    both = before.select("key", F.col("value").alias("a")).join(after.select("key", F.col("value").alias("b")), "key", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


def left_over(all_files: DataFrame, referenced: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the first table that no row of the second refers to: copies to clean up, files to copy."""
    return all_files.join(referenced.select(*key), list(key), "left_anti")


def folded_stages(rows: DataFrame) -> DataFrame:
    """Rows (run, place, stage, hidden, status, wall) with hidden ones folded into the shown one before them: wall times
    add up, and the status is the gravest."""
    w = Window.partitionBy("run").orderBy("place")
    host = F.last(F.when(~F.col("hidden"), F.col("place")), ignorenulls=True).over(w)
    rank = F.when(F.col("status") == "failed", 0).when(F.col("status") == "running", 1).when(F.col("status") == "waiting", 2).otherwise(3)
    return rows.withColumn("host", F.coalesce(host, F.lit(0))).groupBy("run", "host").agg(F.min(F.struct(rank.alias("k"), "status"))["status"].alias("status"), F.sum("wall").alias("wall"), F.count("*").alias("rows"))


def predicted(history: DataFrame, group: str, order: str, ratio: Column, last: int = 12) -> DataFrame:
    """Median ratio of the last runs of each stage: multiplied with the size of a new one, its expected time."""
    recent = history.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))).where(F.col("_k") <= last)
    return recent.groupBy(group).agg(F.percentile(ratio, F.lit(0.5)).alias("ratio"), F.count("*").alias("runs"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the bytes of an ASCII text, as a number."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.when(c == 0, h).otherwise((h.bitwiseXOR(c) * 16777619).bitwiseAND(0xFFFFFFFF)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def progress_of(line: Column) -> Column:
    """(done, total, unit) of a log line such as 'filter: 12/40 blocks'."""
    pattern = r"(\d+)\s*/\s*(\d+)\s*([a-z]*)"
    whole = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern), F.struct(whole(1).cast("long").alias("done"), whole(2).cast("long").alias("total"), whole(3).alias("unit")))


def vertices_of(text: Column) -> Column:
    """Vertices of a text such as '1 2; 3 4': pairs that are not numbers are left out."""
    pairs = F.transform(F.split(text, ";"), lambda t: F.struct(F.regexp_extract(t, r"^\s*(-?[\d.]+)[\s,]+(-?[\d.]+)\s*$", 1).try_cast("double").alias("x"), F.regexp_extract(t, r"^\s*(-?[\d.]+)[\s,]+(-?[\d.]+)\s*$", 2).try_cast("double").alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def duration_text(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    return F.when(s < 60, F.format_string("%d s", s)).when(s < 3600, F.format_string("%d min %d s", F.floor(s / 60), s % 60)).otherwise(F.format_string("%d h %d min", F.floor(s / 3600), F.floor(s % 3600 / 60)))


def matching_speedup(share: Column) -> Column:
    """Estimated gain of matching a share of the photos only."""
    return 1 / (0.31 + 0.69 * share)


def keyframe_budget(photos: int, percent: int = 0) -> int:
    """Photos kept of a scan: a percentage, or 20 of each window of 62; even for 20 and more."""
    windows = [min(62, photos - at) for at in range(0, photos, 62)]
    n = sum(min(w, round(w * percent / 100) if percent else 20) for w in windows)
    return n - n % 2 if n >= 20 else n


def shuffled(df: DataFrame, key: str, seed: int = 20909) -> DataFrame:
    """df with its rows' places in a seeded permutation, 0 to n - 1, the same in every run: the order of the MD5 of seed and
    key, ties by key. Keys are unique and not null.

    Ranks are dense without an order of all rows: rows are counted for each of 4096 beginnings of the hash, and numbered
    within one, of which each is a task's.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 3))
    sums = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # 4096 rows at most
    own = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return hashed.withColumn("_own", own).join(F.broadcast(before), "_b").withColumn("place", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_h", "_b", "_own", "_before")


def placed(df: DataFrame) -> DataFrame:
    """A table read from Parquet, with `place`: the rows' dense numbers over all files, in the order of their names and rows.

    A row's number in its file comes from the scan; files are counted first, a row for each of them.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    sizes = rows.groupBy("_f").agg((F.max("_r") + 1).alias("_n"))
    before = sizes.select("_f", F.coalesce(F.sum("_n").over(Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each file
    return rows.join(before, "_f").withColumn("place", F.col("_before") + F.col("_r")).drop("_f", "_r", "_before")


def compared(result: DataFrame, reference: DataFrame, tolerances: dict[str, float], on: str = "place") -> DataFrame:
    """One row: rows compared, missing and surplus ones, the largest difference of each column, and whether all is within
    `tolerances`. Rows meet by their place; a null equals a null only, and differs infinitely from a number."""
    far = {}
    for c in tolerances:
        a, b = F.col(f"a.{c}").cast("double"), F.col(f"b.{c}").cast("double")
        far[c] = F.when(a.isNull() & b.isNull(), F.lit(0.0)).otherwise(F.coalesce(F.abs(a - b), F.lit(float("inf"))))
    both = result.select(on, *tolerances).alias("a").join(reference.select(on, *tolerances).alias("b"), F.col(f"a.{on}") == F.col(f"b.{on}"), "full")
    in_a, in_b = F.col(f"a.{on}").isNotNull(), F.col(f"b.{on}").isNotNull()
    report = both.agg(F.count_if(in_a & in_b).alias("rows"), F.count_if(~in_a).alias("missing"), F.count_if(~in_b).alias("surplus"), *[F.coalesce(F.max(F.when(in_a & in_b, far[c])), F.lit(0.0)).alias(f"max_{c}") for c in tolerances])
    good = (F.col("missing") == 0) & (F.col("surplus") == 0)
    for c, t in tolerances.items():
        good = good & (F.col(f"max_{c}") <= t)
    return report.withColumn("passed", good)


class Observed:
    """Counts and extremes of stages as they run, without a job of their own: each stage is a DataFrame with an observation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.stages = spark, []

    def stage(self, name: str, df: DataFrame, value: str | None = None) -> DataFrame:
        """df as it is; its rows, and the least and greatest `value`, are known once it has run."""
        seen = Observation(name)
        column = F.col(value).cast("double") if value else F.lit(None).cast("double")
        self.stages.append((name, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(column).alias("least"), F.max(column).alias("most"))

    def table(self) -> DataFrame:
        """(stage, rows, least, most), a row for each stage; waits for stages that have not run."""
        rows = [(name, seen.get["rows"], seen.get["least"], seen.get["most"]) for name, seen in self.stages]
        return self.spark.createDataFrame(rows, "stage string, rows long, least double, most double")


def stage_metrics(spark: SparkSession) -> DataFrame:
    """What Spark has measured of the stages it ran: tasks, seconds run and on the CPU, peak execution memory, rows and bytes."""
    out = []
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    for k in range(stages.size()):
        s = stages.apply(k)
        out.append((s.stageId(), s.attemptId(), s.name(), s.numCompleteTasks(), s.executorRunTime() / 1e3, s.executorCpuTime() / 1e9, s.peakExecutionMemory(), s.inputRecords(), s.shuffleWriteBytes(), s.memoryBytesSpilled()))
    return spark.createDataFrame(out, "stage long, attempt long, name string, tasks long, run_s double, cpu_s double, peak_memory long, rows_in long, shuffled long, spilled long")
