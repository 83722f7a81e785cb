"""Experiment-matrix planning: cross products with filters, routing and grouping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ordered_table(spark: SparkSession, names: Sequence, value: str, ordinal: str) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], f"{ordinal} int, {value} {'int' if isinstance(names[0], int) else 'string'}")


def select_known(allowed: Sequence, requested: Sequence | None, what: str) -> list:
    """Requested values in the allowed order; an unknown one raises, None asks for all."""
    if requested is None:
        return list(allowed)
    unknown = [r for r in requested if r not in allowed]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(map(str, unknown))}")
    return [a for a in allowed if a in requested]


def route(model: Column, kind: Column, routes: Mapping[str, Mapping[str, str]]) -> Column:
    """Recipe of a model: its route for the kind, else its route for ``all``."""
    table = F.create_map(*[F.lit(x) for m, r in routes.items() for k, v in r.items() for x in (f"{m}|{k}", v)])
    return F.coalesce(
        F.try_element_at(table, F.concat_ws("|", model, kind)), F.try_element_at(table, F.concat(model, F.lit("|all")))
    )


def evaluation_jobs(cells: DataFrame, models: DataFrame, seeds: DataFrame, routes: Mapping) -> DataFrame:
    """Every model, cell and seed in that order.  Model and seed lists are fixed plan input of
    a few rows, so the product grows with the cells only."""
    jobs = models.crossJoin(cells).crossJoin(seeds)
    return jobs.select(
        F.concat_ws("_", "model", "evaluation_id", F.concat(F.lit("s"), F.col("seed").cast("string"))).alias("job_id"),
        "model_ordinal", "model", "cell_ordinal", "evaluation_id", "evaluation_kind", "seed_ordinal", "seed",
        "source_configuration_id", "target_configuration_id",
        route(F.col("model"), F.col("evaluation_kind"), routes).alias("recipe"),
    )


def source_jobs(cells: DataFrame, models: DataFrame, seeds: Sequence[int] | None = None) -> DataFrame:
    """One job per model and distinct source; with ``seeds`` as training jobs holding the list."""
    sources = cells.select("source_configuration_id").distinct()
    jobs = models.crossJoin(sources)
    name = F.concat_ws("_", F.lit("train" if seeds else "prep"), "model", "source_configuration_id")
    out = jobs.select(name.alias("job_id"), "model", "source_configuration_id")
    return out.withColumn("seeds", F.array(*[F.lit(s) for s in seeds])) if seeds else out


def grouped_commands(jobs: DataFrame, *, keys: Sequence[str], order: Sequence[str], item: str) -> DataFrame:
    """Jobs of one command as an ordered list of ids, with their number."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, item)))
    return jobs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("jobs"), F.array_join(F.transform(ordered, lambda x: x[item].cast("string")), " ").alias("job_list")
    )


def fill_template(template: str, values: Mapping[str, object]) -> str:
    """``{name}`` places filled in; an unknown name raises."""
    try:
        return template.format_map(dict(values))
    except KeyError as missing:
        raise ValueError(f"unknown placeholder {missing}") from None


def product_coverage(rows: DataFrame, dimensions: Mapping[str, DataFrame], within: str | None = None) -> DataFrame:
    """How far ``rows`` cover the product of small dimension tables: keys ``missing`` from it
    and ``unexpected`` in it, and ``repeated`` ones.  With ``within``, a column that every
    dimension table has too, there is one product for each of its values."""
    names = [*([within] if within else []), *dimensions]
    full = None
    for d in dimensions.values():
        full = d if full is None else full.join(d, within) if within else full.crossJoin(d)
    have = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    j = full.select(*names, F.lit(True).alias("due")).join(have, names, "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return j.select(*names, state.alias("state")).where("state is not null")
