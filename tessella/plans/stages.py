"""The linkage run from raw files to result lists, stage by stage over one folder; each stage reads what earlier ones wrote.

    convert   separated text to Parquet, with the ground truth as pairs
    split     frozen lists of training and validation queries
    clean     names and addresses of every source; a row stays a row
    learn     a table of state spellings from training pairs, applied to every source
    block     candidates of a split by all four passes
    features  48 features for each candidate
    train     a matcher on the training queries' candidates, and a threshold on the validation queries'
    evaluate  macro F0.5 of the validation queries by country
    predict   scores, decisions and result lists of a split, validated

A stage that is run again with the same settings keeps what is there; see :func:`tessella.sources.files.run_once`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import cleaning, decision, evaluation, features, lookup, model, quality, sampling
from tessella.operators import candidates as C
from tessella.sources import files, tables
from tessella.sources.stored import written

SOURCES = (1, 2, 3)
KEYS = ("s1_id", "cand_id", "country")
TRUTH = ["source1_entity_id", "matched_entity_ids"]


@dataclass(frozen=True)
class Run:
    """folder: of everything the run writes. learned: countries for which state spellings are learned, all if none is named."""

    spark: SparkSession
    folder: str
    blocking: evaluation.Blocking = evaluation.Blocking()
    min_states: int = 100
    min_share: float = 0.9
    learned: tuple[str, ...] = ()
    trees: int = 20
    depth: int = 5

    def at(self, *parts: object) -> str:
        return "/".join([self.folder.rstrip("/"), *map(str, parts)])

    def read(self, *parts: object) -> DataFrame:
        return self.spark.read.parquet(self.at(*parts))

    def once(self, make: Callable[[], DataFrame], settings: dict, *parts: object) -> DataFrame:
        return files.run_once(self.spark, self.at(*parts), {"version": cleaning.VERSION, **settings}, make)

    def ids(self, name: str) -> DataFrame:
        return files.named_ids(self.spark, self.at("splits"), name)


def convert(run: Run, sources: dict[tuple[str, int], str], truth: str) -> None:
    """``sources`` names a tab-separated file for (split, number); ids must be unique, well formed and of that source."""
    for (split, number), path in sources.items():
        df = run.once(lambda path=path, number=number: tables.with_source(tables.read_tsv(run.spark, path), number), {"from": path}, "raw", split, number)
        bad = df.where(~quality.id_source(F.col("entity_id")).eqNullSafe(F.lit(number))).count()
        if bad or df.count() != df.select("entity_id").distinct().count():
            raise ValueError(f"{path}: {bad} ids aren't of source {number}, or some repeat")
    kind = tables.T.StructType([tables.T.StructField(c, tables.T.StringType()) for c in TRUTH])
    wide = lambda: tables.read_tsv(run.spark, truth, kind).toDF("s1_id", "ids")
    run.once(lambda: tables.truth_long(wide()), {"from": truth}, "truth")


def split(run: Run, percent: int = 20) -> None:
    """Lists ``train_ids`` and ``val_ids`` of the queries with a known truth; existing lists are never overwritten."""
    ids = run.read("truth").select("s1_id").distinct()
    held = sampling.is_validation(F.col("s1_id"), percent)
    files.write_ids(ids.where(~held), run.at("splits", "train_ids"))
    files.write_ids(ids.where(held), run.at("splits", "val_ids"))


def clean(run: Run, split: str) -> None:
    for number in SOURCES:
        raw = run.read("raw", split, number)
        done = run.once(lambda raw=raw: cleaning.clean_addresses(cleaning.clean_names(raw)), {}, "clean", split, number)
        if done.count() != raw.count():
            raise ValueError(f"cleaning changed the number of rows of source {number}")


def cleaned(run: Run, split: str) -> DataFrame:
    return tables.read_sources(run.spark, {n: run.at("clean", split, n) for n in SOURCES})


def learn(run: Run, split: str = "train") -> None:
    """State spellings from the pairs of training queries alone, and ``states`` beside every record of the split."""
    train = run.ids("train_ids")
    pairs = lookup.training_pairs(run.read("truth"), run.ids("val_ids")).join(train, "s1_id", "left_semi").withColumnRenamed("match_id", "cand_id")
    aligned = evaluation.aligned_states(pairs, cleaned(run, split))
    table = run.once(lambda: lookup.learn_mapping(aligned, run.min_states, run.min_share, run.learned), {"n": run.min_states, "share": run.min_share}, "states", "table")
    tables.write_manifest(run.spark, run.at("states", "facts.json"), evaluation.learning_facts(aligned, train, rows=str(table.count())))


def records(run: Run, split: str) -> tuple[DataFrame, DataFrame]:
    """Queries and pool of a split with canonical states and chain counts."""
    with_states = lookup.apply_mapping(cleaned(run, split), run.read("states", "table"), "addr_state_raw", "addr_state_canon")
    s1, pool = evaluation.sides(with_states)
    chains = C.chain_counts(s1.select("country", F.col("name_core").alias("name"))).withColumnRenamed("name", "name_core")
    columns = ["entity_id", "country", *features.ENTITY]
    return tuple(side.join(chains, ["country", "name_core"], "left").select(*columns) for side in (s1, pool))


def block(run: Run, split: str) -> DataFrame:
    return run.once(lambda: evaluation.block(*records(run, split), run.blocking), asdict(run.blocking), "candidates", split)


def make_features(run: Run, split: str) -> DataFrame:
    kept = lambda: (written(df, "records", compression="zstd") for df in records(run, split))
    return run.once(lambda: features.pair_features(run.read("candidates", split), *kept()), asdict(run.blocking), "features", split)


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*KEYS, "label")]


def _truth(run: Run) -> DataFrame:
    return run.read("truth").where("match_id IS NOT NULL").withColumnRenamed("match_id", "cand_id")


def train(run: Run, split: str = "train") -> None:
    """Fits on the training queries' pairs and chooses the threshold on the validation queries'."""
    rows = model.labelled(run.read("features", split), _truth(run))
    fitted = model.train(rows.join(run.ids("train_ids"), "s1_id", "left_semi"), columns(rows), trees=run.trees, depth=run.depth)
    fitted.write().overwrite().save(run.at("models", "matcher"))
    gains = run.spark.createDataFrame(model.importance(fitted, columns(rows)), "feature string, gain double")
    files.write_csv(gains, run.at("models", "importance"))
    held = run.ids("val_ids")
    scored = _scored(run, split).join(held, "s1_id", "left_semi").drop("country")
    best = decision.best_threshold(decision.threshold_search(scored, held, _truth(run).join(held, "s1_id", "left_semi"))).first()
    tables.write_manifest(run.spark, run.at("models", "matcher.json"), {"threshold_pct": best.threshold_pct, "macro_f05": best.macro_f05})


def _scored(run: Run, split: str) -> DataFrame:
    rows = run.read("features", split)
    return model.score(PipelineModel.load(files.newest_model(run.spark, run.at("models"), "stages")), rows, columns(rows), KEYS)


def threshold(run: Run) -> float:
    return tables.read_manifest(run.spark, run.at("models", "matcher.json"))["threshold_pct"] / 100


def evaluate(run: Run, split: str = "train") -> DataFrame:
    held = run.ids("val_ids")
    asked = records(run, split)[0].select(F.col("entity_id").alias("s1_id"), "country").join(held, "s1_id", "left_semi")
    matches = decision.decide(_scored(run, split).join(held, "s1_id", "left_semi"), threshold(run))
    per_query = decision.per_s1_f05(matches, asked, _truth(run).join(held, "s1_id", "left_semi"))
    out = decision.macro_f05(per_query, "country")
    files.write_csv(out, run.at("reports", "evaluation"))
    return out


def predict(run: Run, split: str = "test") -> DataFrame:
    """Writes ``matches`` and ``candidates`` lists with a row for every query, and returns the validator's findings."""
    s1, pool = records(run, split)
    asked = s1.select(F.col("entity_id").alias("s1_id"))
    candidates = tables.list_output(run.read("candidates", split), asked)
    matches = tables.list_output(decision.decide(_scored(run, split), threshold(run)), asked)
    for name, lists in (("candidates", candidates), ("matches", matches)):
        tables.removed(run.spark, run.at("lists", split, name))
        tables.write_lists(lists, run.at("lists", split, name), TRUTH[0], "candidate_entity_ids" if name == "candidates" else TRUTH[1])
    ids = pool.select(F.col("entity_id").alias("match_id"))
    entries = candidates.select("s1_id", F.explode(F.split("ids", ",")).alias("match_id"))
    return quality.validate_lists(matches, asked, ids, entries)


STAGES = {"split": split, "clean": clean, "learn": learn, "block": block, "features": make_features, "train": train, "evaluate": evaluate, "predict": predict}
