"""Event names: catalogue views, spellings, resolution to a logical event, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfall.functions.measures import rate
from stepfall.functions.spelling import TRANSFORMS, name_skeleton, sentence_of, spellings
from stepfall.plans.joins import small_side


def dictionary_entries(forms: DataFrame, purposes: DataFrame | None = None) -> DataFrame:
    """Documented forms as dictionary rows.

    ``purposes(canonical, description)`` overrides the generic sentence.  The description
    depends on the logical event alone, so equal descriptions mean the same event.
    """
    shown = forms.filter("documented")
    text = sentence_of(F.col("canonical"))
    if purposes is not None:
        shown = shown.join(small_side(purposes), "canonical", "left")
        text = F.coalesce(F.col("description"), text)
    return shown.select(F.col("name").alias("event_name"), "status", text.alias("description"))


def canonical_map(forms: DataFrame) -> DataFrame:
    """Firing name -> logical event (restricted)."""
    return forms.filter("fires").select(F.col("name").alias("event_name"), "canonical")


def forms_by_canonical(forms: DataFrame) -> DataFrame:
    """Firing forms with the number of forms and the weight share within their event.

    Rows stay rows instead of one list per event, so no event's forms gather in one cell.
    """
    firing = forms.filter("fires")
    totals = firing.groupBy("canonical").agg(
        F.count("*").alias("n_forms"), F.sum("weight").alias("total"))
    return firing.join(totals, "canonical").select(
        "canonical", "name", "status", "documented", "weight", "n_forms",
        F.try_divide(F.col("weight"), F.col("total")).alias("weight_share"))


def dictionary_stats(forms: DataFrame) -> DataFrame:
    """The five catalogue counts."""
    fires, documented = F.col("fires"), F.col("documented")
    return forms.agg(
        F.count("*").alias("n_surface_forms"),
        F.count_if(documented).alias("n_dictionary_entries"),
        F.count_if(fires).alias("n_firing_names"),
        F.count_if(fires & ~documented).alias("n_undocumented_firing"),
        F.count_if(documented & ~fires).alias("n_stale_documented"))


def name_variants(bases: DataFrame) -> DataFrame:
    """The seven spellings of every base name (column ``base``)."""
    made = spellings(F.col("base"))
    rows = F.array(*(F.struct(F.lit(t).alias("transform"), made[t].alias("variant"))
                     for t in TRANSFORMS))
    return bases.select("base", F.explode(rows).alias("v")).select("base", "v.*")


def owned_variants(bases: DataFrame) -> DataFrame:
    """Each distinct spelling once, owned by the first base in catalogue order (``position``)."""
    made = name_variants(bases).join(bases.select("base", "position"), "base")
    owner = F.min(F.struct("position", "base")).alias("o")
    return made.groupBy("variant").agg(owner).select("variant", F.col("o.base").alias("base"))


def resolve_exact(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach the logical event by exact name; unknown names get null.

    The map is broadcast while it is small, else joined plainly (see ``plans.joins``).
    """
    return events.join(small_side(mapping), "event_name", "left")


def dictionary_keys(dictionary: DataFrame) -> DataFrame:
    """Skeleton -> description, where the documented names behind a skeleton agree on one."""
    return (
        dictionary.groupBy(name_skeleton(F.col("event_name")).alias("skeleton"))
        .agg(F.min("description").alias("by_skeleton"), F.max("description").alias("other"))
        .filter(F.col("by_skeleton") == F.col("other"))
        .drop("other")
    )


def resolve_names(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Logical key of every distinct raw name: its description, found exactly or by skeleton.

    Works on the distinct names, never on the event rows, and reads public tables only.
    """
    names = events.select("event_name").distinct()
    exact = dictionary.groupBy("event_name").agg(F.min("description").alias("exact"))
    return (
        names.join(exact, "event_name", "left")
        .withColumn("skeleton", name_skeleton(F.col("event_name")))
        .join(dictionary_keys(dictionary), "skeleton", "left")
        .select(
            "event_name",
            F.coalesce("exact", "by_skeleton").alias("logical_key"),
            F.when(F.col("exact").isNotNull(), F.lit("exact"))
            .when(F.col("by_skeleton").isNotNull(), F.lit("skeleton"))
            .otherwise(F.lit("none")).alias("how"))
    )


def resolve_events(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Attach ``logical_key`` to every event from the public dictionary alone.

    Two joins with the dictionary's own keys: no distinct pass over the stream is needed.
    """
    exact = dictionary.groupBy("event_name").agg(F.min("description").alias("exact"))
    return (
        events.join(small_side(exact), "event_name", "left")
        .withColumn("skeleton", name_skeleton(F.col("event_name")))
        .join(small_side(dictionary_keys(dictionary)), "skeleton", "left")
        .withColumn("logical_key", F.coalesce("exact", "by_skeleton"))
        .drop("skeleton", "exact", "by_skeleton")
    )


def dictionary_audit(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names in the data against names in the dictionary.

    ok, undocumented (fires only), silent (documented only), deprecated_firing.
    """
    fired = events.groupBy("event_name").agg(F.count("*").alias("n"))
    listed = dictionary.groupBy("event_name").agg(F.min("status").alias("status"))
    return (
        fired.join(listed.withColumn("documented", F.lit(True)), "event_name", "full_outer")
        .select(
            "event_name",
            F.coalesce("documented", F.lit(False)).alias("documented"),
            "status",
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n_events"),
            F.when(F.col("documented").isNull(), F.lit("undocumented"))
            .when(F.col("n").isNull(), F.lit("silent"))
            .when(F.col("status") == "deprecated", F.lit("deprecated_firing"))
            .otherwise(F.lit("ok")).alias("class"))
    )


def resolution_pr(resolved: DataFrame, mapping: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Precision and recall of a resolution against the restricted map of firing names."""
    meant = (
        dictionary.join(mapping, "event_name").groupBy(F.col("description").alias("logical_key"))
        .agg(F.min("canonical").alias("claimed")))
    judged = mapping.join(
        resolved.select("event_name", "logical_key"), "event_name", "left"
    ).join(meant, "logical_key", "left")
    counts = judged.agg(
        F.count("*").alias("n_names"),
        F.count_if(F.col("logical_key").isNotNull()).alias("n_resolved"),
        F.count_if(F.col("claimed") == F.col("canonical")).alias("n_right"))
    return counts.select(
        "*", rate(F.col("n_right"), F.col("n_resolved")).alias("precision"),
        rate(F.col("n_right"), F.col("n_names")).alias("recall"))
