"""Findings, incidents and column notes as tables.

A finding row has: model, dataset, column, headline, change, mechanism,
why_missed, fix, features (array), proven (array), inferred (array) and an impact
struct (affected_rows, naive_mae_per_row, naive_amount, did_mae_per_row, did_amount).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

ACTIVE, RESOLVED = "ACTIVE", "RESOLVED"


def prefer_did(name: str) -> Column:
    """The stricter estimate where there is one; absent or zero falls back to the naive one."""
    did, naive = F.col(f"impact.did_{name}"), F.col(f"impact.naive_{name}")
    return F.when(did.isNotNull() & (did != 0), did).otherwise(naive)


def section(title: str, body: Column) -> Column:
    return F.concat(F.lit(f"## {title}\n"), F.coalesce(body, F.lit("")))


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


#: How an incident reads: heading and column of a finding, in the order of its schema.
LAYOUT = (
    ("What changed", "change"), ("How it does damage", "mechanism"), ("Silence of the monitors", "why_missed"),
    ("Remedy", "fix"), ("Damaged inputs", "features"), ("Measured", "proven"), ("Concluded", "inferred"),
)


def incident_rows(findings: DataFrame, layout: Sequence[tuple[str, str]] = LAYOUT) -> DataFrame:
    """One incident per finding, raised on the source dataset.

    The description opens with where the damage sits and what it costs (total and per-row
    cost come from the same estimator, so they multiply) and then has a section for every
    column that ``layout`` names; arrays become lists. The title is the whole headline.
    """
    amount, per_row = prefer_did("amount"), prefer_did("mae_per_row")
    lead = F.concat(
        F.concat_ws(".", "dataset", "column"), F.lit(" -> "), F.col("model"), F.lit(": "), F.format_number(amount, 2), F.lit(" = "),
        F.format_number(F.col("impact.affected_rows"), 0), F.lit(" rows x "), F.format_number(per_row, 4),
    )
    kinds = dict(findings.dtypes)
    sections = [section(title, bullets(F.col(c)) if kinds[c].startswith("array") else F.col(c)) for title, c in layout]
    return findings.select(
        F.col("dataset"),
        F.lit("CUSTOM").alias("incident_type"),
        F.lit("Semantic drift").alias("custom_type"),
        F.col("headline").alias("title"),
        F.concat_ws("\n\n", lead, *sections).alias("description"),
        amount.alias("amount"),
        F.lit("HIGH").alias("priority"),
        F.lit(ACTIVE).alias("state"),
    )


def supersede_incidents(ledger: DataFrame, new: DataFrame, on: str = "dataset") -> DataFrame:
    """Resolve every active incident of a dataset that gets a new one, then add the new ones."""
    replaced = new.select(on).distinct().withColumn("_replaced", F.lit(True))
    resolve = (F.col("state") == ACTIVE) & F.col("_replaced").isNotNull()
    kept = ledger.join(replaced, on, "left").withColumn("state", F.when(resolve, RESOLVED).otherwise(F.col("state")))
    return kept.select(*ledger.columns).unionByName(new.select(*ledger.columns))


def annotate_column(catalog: DataFrame, findings: DataFrame, features: DataFrame, tasks: int | None = None) -> DataFrame:
    """Append the findings of a column to its description, with all features it feeds.

    One row per catalog row: several findings of a column become one note each, in order.
    A column without a description gets the note alone. Features are listed of columns with a
    finding only; they are dealt by column once, into ``tasks`` partitions if given, so that the
    memory of a task is as its caller sizes it.
    """
    key = ["dataset", "column"]
    fed = features.select(*key, "feature").join(findings.select(*key).distinct(), key, "left_semi")
    dealt = fed.repartition(*key) if tasks is None else fed.repartition(tasks, *key)
    listed = dealt.distinct().groupBy(*key).agg(
        F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_list("feature")), ", ").alias("_features")
    )
    changes = findings.groupBy(*key).agg(F.array_sort(F.collect_list("change")).alias("_changes"))
    noted = catalog.join(changes, key, "left").join(listed, key, "left")
    feeds = F.coalesce(F.concat(F.lit(" Feeds "), F.col("_n").cast("string"), F.lit(": "), F.col("_features"), F.lit(".")), F.lit(""))
    notes = F.transform("_changes", lambda c: F.concat(F.lit("[decay] "), c, feeds))
    return noted.select(
        *key,
        F.when(F.col("_changes").isNull(), F.col("description"))
        .otherwise(F.concat_ws("\n\n", F.nullif("description", F.lit("")), F.array_join(notes, "\n\n"))).alias("description"),
    )


def resolve_marked(incidents: DataFrame, marker: str) -> DataFrame:
    """Resolve the incidents whose title carries the marker."""
    return incidents.withColumn(
        "state", F.when(F.col("title").contains(marker), RESOLVED).otherwise(F.col("state"))
    )


def drop_marked(documents: DataFrame, prefix: str) -> DataFrame:
    """Keep the documents whose title does not start with the marker; untitled ones stay."""
    return documents.filter(~F.coalesce(F.col("title").startswith(prefix), F.lit(False)))


def restore_notes(catalog: DataFrame, originals: DataFrame) -> DataFrame:
    """Put back the recorded description of every column that was recorded, an empty one too."""
    key = ["dataset", "column"]
    kept = originals.select(*key, F.col("description").alias("_original"), F.lit(True).alias("_recorded"))
    return catalog.join(kept, key, "left").select(
        *key, F.when(F.col("_recorded"), F.col("_original")).otherwise(F.col("description")).alias("description")
    )


def ledger_state(incidents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return incidents.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == ACTIVE).alias("active"),
        F.count_if(F.col("state") == RESOLVED).alias("resolved"),
    )


def annotated_columns(catalog: DataFrame, mark: str = "[decay]") -> DataFrame:
    """Columns with a description, and whether it carries a finding."""
    return catalog.filter(F.length(F.coalesce("description", F.lit(""))) > 0).select(
        "dataset", "column", F.col("description").contains(mark).alias("has_finding")
    )


def finding_document(findings: DataFrame, trace: Column | None = None) -> DataFrame:
    """The finding as one text: cause, mechanism, what is proven and what is inferred."""
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), F.col("headline")),
        section("Cause", F.concat_ws(".", "dataset", "column")),
        F.col("change"),
        section("Mechanism", F.col("mechanism")),
        section("Proven", bullets(F.col("proven"))),
        section("Inferred", bullets(F.col("inferred"))),
        section("Trace", trace) if trace is not None else F.lit(None).cast("string"),
    )
    return findings.select(
        "dataset", "column", F.concat(F.lit("Root cause: "), F.col("column")).alias("title"), text.alias("content")
    )
