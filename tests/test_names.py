from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepfall.functions.spelling import name_skeleton
from stepfall.operators import names

FORMS = "name string, canonical string, fires boolean, documented boolean, status string, weight double"


def catalogue(spark):
    return spark.createDataFrame([
        ("checkout_start", "checkout_start", True, True, "active", 1.0),
        ("begin_checkout", "checkout_start", True, True, "deprecated", 0.25),
        ("evt_begin_checkout", "checkout_start", True, False, "active", 0.25),
        ("CartView", "cart_view", True, True, "active", 1.0),
        ("anr", "crash", True, False, "active", 1.0),
        ("old_cart_flow", "cart_view", False, True, "deprecated", 0.0)], FORMS)


def fired(spark):
    return catalogue(spark).filter("fires").select(F.col("name").alias("event_name"))


def test_seven_spellings(spark):
    base = spark.createDataFrame([("product_detail_view",)], "base string")
    assert dict(rows(names.name_variants(base), "transform", "variant")) == {
        "snake": "product_detail_view", "camel": "productDetailView",
        "pascal": "ProductDetailView", "kebab": "product-detail-view",
        "evt": "evt_product_detail_view", "track": "track_product_detail_view",
        "abbrev": "prdct_dtl_vw"}


def test_short_words_keep_their_vowels(spark):
    base = spark.createDataFrame([("app_open",), ("pdp_view",)], "base string")
    got = names.name_variants(base).filter("transform = 'abbrev'")
    assert rows(got, "variant") == [("app_opn",), ("pdp_vw",)]


word = st.text("abcdefghijklmnopqrstuvwxyz", min_size=2, max_size=9)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(word, min_size=1, max_size=4).map("_".join).filter(
    lambda s: not s.startswith(("evt_", "track_"))), min_size=1, max_size=8, unique=True))
def test_all_spellings_share_one_skeleton(spark, made):
    base = spark.createDataFrame([(b,) for b in made], "base string")
    keys = names.name_variants(base).groupBy("base").agg(
        F.count_distinct(name_skeleton(F.col("variant"))).alias("n"))
    assert {r.n for r in keys.collect()} == {1}


def test_first_owner_wins(spark):
    base = spark.createDataFrame([("tap", 2), ("track_tap", 1)], "base string, position int")
    got = names.owned_variants(base).filter("variant = 'track_tap'")
    assert rows(got, "base") == [("track_tap",)]


def test_dictionary_and_map(spark):
    entries = names.dictionary_entries(catalogue(spark))
    assert rows(entries, "event_name", "description") == [
        ("CartView", "Cart view event."), ("begin_checkout", "Checkout start event."),
        ("checkout_start", "Checkout start event."), ("old_cart_flow", "Cart view event.")]
    own = spark.createDataFrame([("cart_view", "Shows the cart.")], "canonical string, description string")
    assert ("CartView", "Shows the cart.") in rows(
        names.dictionary_entries(catalogue(spark), own), "event_name", "description")
    assert names.canonical_map(catalogue(spark)).count() == 5


def test_stats(spark):
    assert names.dictionary_stats(catalogue(spark)).collect()[0].asDict() == {
        "n_surface_forms": 6, "n_dictionary_entries": 4, "n_firing_names": 5,
        "n_undocumented_firing": 2, "n_stale_documented": 1}


def test_weights_share(spark):
    got = names.forms_by_canonical(catalogue(spark)).filter("canonical = 'checkout_start'")
    assert rows(got, "name", "n_forms", "weight_share") == [
        ("begin_checkout", 3, 0.25 / 1.5), ("checkout_start", 3, 1 / 1.5),
        ("evt_begin_checkout", 3, 0.25 / 1.5)]


def test_resolution(spark):
    entries = names.dictionary_entries(catalogue(spark))
    got = names.resolve_names(fired(spark), entries)
    assert rows(got, "event_name", "logical_key", "how") == [
        ("CartView", "Cart view event.", "exact"), ("anr", None, "none"),
        ("begin_checkout", "Checkout start event.", "exact"),
        ("checkout_start", "Checkout start event.", "exact"),
        ("evt_begin_checkout", "Checkout start event.", "skeleton")]
    pr = names.resolution_pr(got, names.canonical_map(catalogue(spark)), entries).collect()[0]
    assert (pr.n_names, pr.n_resolved, pr.n_right, pr.precision, pr.recall) == (5, 4, 4, 1.0, 0.8)
    by_event = names.resolve_events(fired(spark), entries)
    assert rows(by_event, "event_name", "logical_key") == rows(got, "event_name", "logical_key")


def test_an_ambiguous_skeleton_resolves_nothing(spark):
    entries = spark.createDataFrame(
        [("big_sale", "active", "One."), ("BigSale", "active", "Two.")],
        "event_name string, status string, description string")
    events = spark.createDataFrame([("big-sale",)], "event_name string")
    assert rows(names.resolve_names(events, entries), "how") == [("none",)]


def test_audit_classes(spark):
    got = names.dictionary_audit(fired(spark), names.dictionary_entries(catalogue(spark)))
    assert rows(got, "event_name", "class", "n_events") == [
        ("CartView", "ok", 1), ("anr", "undocumented", 1),
        ("begin_checkout", "deprecated_firing", 1), ("checkout_start", "ok", 1),
        ("evt_begin_checkout", "undocumented", 1), ("old_cart_flow", "silent", 0)]
