"""Provenance: hash chains over dataset versions and the integrity of everything they reference.

``versions`` has version_id, dataset_id, source_id, version_number, previous_version_id, record_count, content_hash, manifest (JSON text),
provenance_hash, created_at. ``contents`` is what the stored records give today: version_id, record_count, content_hash.
``datasets`` and ``sources`` hold an id, the stored hash and the descriptor as JSON text; ``links`` hold id,
upstream_version_id, downstream_version_id, relation_type, link_hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import fired

LINK_FORMAT, LINK_RULES = "ledgerframe.lineage-link/1.0", "1.0.0"
MANIFEST_KEYS = ("version_id", "dataset_id", "source_id", "version_number", "record_count", "content_hash", "previous_version_id", "created_at")


def link_hash(upstream: Column, upstream_content: Column, downstream: Column, downstream_content: Column, relation: Column) -> Column:
    """Binds a link to the content of both its ends."""
    return F.sha2(F.to_json(F.struct(F.lit(LINK_FORMAT).alias("format"), upstream.alias("upstream"), upstream_content.alias("upstream_content"), downstream.alias("downstream"), downstream_content.alias("downstream_content"), relation.alias("relation"), F.lit(LINK_RULES).alias("rules"))), 256)


def _said(key: str) -> Column:
    return F.get_json_object("manifest", f"$.{key}")


def version_integrity(versions: DataFrame, datasets: DataFrame, sources: DataFrame, contents: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """version_id, issues (sorted codes): every check of a version, its manifest and its stored predecessor, once for all analyses.

    ``of`` (version_id) limits the check to some versions; then ``contents`` needs only theirs.
    """
    d = datasets.select(F.col("dataset_id"), F.col("dataset_hash").alias("_dh"))
    s = sources.select(F.col("source_id"), F.col("source_hash").alias("_sh"))
    c = contents.select("version_id", F.col("record_count").alias("_rc"), F.col("content_hash").alias("_ch"))
    p = versions.select(F.col("version_id").alias("previous_version_id"), F.col("dataset_id").alias("_pd"), F.col("version_number").alias("_pn"), F.col("provenance_hash").alias("_pp"))
    own = versions if of is None else versions.join(of.select("version_id"), "version_id", "left_semi")
    v = own.join(c, "version_id", "left").join(d, "dataset_id", "left").join(s, "source_id", "left").join(p, "previous_version_id", "left")
    has_previous = F.col("previous_version_id").isNotNull()
    found = has_previous & F.col("_pn").isNotNull()
    text = lambda k: F.col(k).cast("string")
    issues = fired(
        ("invalid_stored_json", F.try_parse_json("manifest").isNull()),
        ("content_hash_mismatch", ~F.col("content_hash").eqNullSafe(F.col("_ch"))),
        ("provenance_hash_mismatch", F.sha2("manifest", 256) != F.col("provenance_hash")),
        ("record_count_mismatch", ~F.col("record_count").eqNullSafe(F.col("_rc"))),
        *((f"manifest_{k}_mismatch", ~_said(k).eqNullSafe(text(k))) for k in MANIFEST_KEYS),
        ("manifest_dataset_hash_mismatch", F.col("_dh").isNotNull() & ~_said("dataset_hash").eqNullSafe(F.col("_dh"))),
        ("manifest_source_hash_mismatch", F.col("_sh").isNotNull() & ~_said("source_hash").eqNullSafe(F.col("_sh"))),
        ("dataset_reference_missing", F.col("_dh").isNull()),
        ("source_reference_missing", F.col("_sh").isNull()),
        ("previous_version_reference_missing", has_previous & F.col("_pn").isNull()),
        ("previous_version_dataset_mismatch", found & (F.col("_pd") != F.col("dataset_id"))),
        ("previous_version_number_break", found & (F.col("_pn") != F.col("version_number") - 1)),
        ("previous_provenance_hash_mismatch", found & ~_said("previous_provenance_hash").eqNullSafe(F.col("_pp"))),
    )
    return v.select("version_id", F.array_sort(issues).alias("issues"))


def descriptor_integrity(resources: DataFrame, id_col: str, hash_col: str, kind: str) -> DataFrame:
    """resource_type, resource_id, issues of datasets or sources: the descriptor must hash to what is stored."""
    issues = fired(("invalid_stored_json", F.try_parse_json("descriptor").isNull()), (f"{kind}_hash_mismatch", F.sha2("descriptor", 256) != F.col(hash_col)))
    return resources.select(F.lit(kind).alias("resource_type"), F.col(id_col).alias("resource_id"), issues.alias("issues"))


def link_integrity(links: DataFrame, versions: DataFrame) -> DataFrame:
    """resource_type, resource_id, issues of lineage links."""
    end = lambda side: versions.select(F.col("version_id").alias(f"{side}_version_id"), F.col("content_hash").alias(f"_{side}"))
    l = links.join(end("upstream"), "upstream_version_id", "left").join(end("downstream"), "downstream_version_id", "left")
    lost = F.col("_upstream").isNull() | F.col("_downstream").isNull()
    expected = link_hash(F.col("upstream_version_id"), F.col("_upstream"), F.col("downstream_version_id"), F.col("_downstream"), F.col("relation_type"))
    issues = fired(("lineage_endpoint_missing", lost), ("lineage_link_hash_mismatch", ~lost & (expected != F.col("link_hash"))))
    return l.select(F.lit("lineage_link").alias("resource_type"), F.col("id").alias("resource_id"), issues.alias("issues"))


def verify_chain(versions: DataFrame, datasets: DataFrame, sources: DataFrame, contents: DataFrame) -> DataFrame:
    """Each dataset's chain by order of version_number: version_id, dataset_id, version_number, issues (sorted).

    All checks of ``version_integrity``, and that the predecessor a version states, in its row and its manifest, is the one before it in order.
    """
    order = Window.partitionBy("dataset_id").orderBy("version_number", "version_id")
    v = versions.withColumn("_before", F.lag("version_id").over(order)).withColumn("_proof", F.lag("provenance_hash").over(order))
    in_order = fired(
        ("previous_version_mismatch", ~F.col("previous_version_id").eqNullSafe(F.col("_before"))),
        ("manifest_previous_version_id_mismatch", ~_said("previous_version_id").eqNullSafe(F.col("_before"))),
        ("previous_provenance_hash_mismatch", ~_said("previous_provenance_hash").eqNullSafe(F.col("_proof"))),
    )
    own = version_integrity(versions, datasets, sources, contents)
    out = v.select("version_id", "dataset_id", "version_number", in_order.alias("_order")).join(own, "version_id")
    return out.select("version_id", "dataset_id", "version_number", F.array_sort(F.array_union("issues", "_order")).alias("issues"))


def chain_upto(versions: DataFrame, version_id: str) -> DataFrame:
    """A version's row and those of all before it in its dataset."""
    target = versions.where(F.col("version_id") == version_id).select("dataset_id", F.col("version_number").alias("_n"))
    return versions.join(F.broadcast(target), "dataset_id").where(F.col("version_number") <= F.col("_n")).drop("_n")  # one row


def verify_version(versions: DataFrame, datasets: DataFrame, sources: DataFrame, contents: DataFrame, version_id: str) -> DataFrame:
    """One row: version_id, valid, checked_versions, issues (version:code) of the version and all before it in its dataset."""
    found = verify_chain(chain_upto(versions, version_id), datasets, sources, contents)
    found = found.select(F.col("issues").alias("_i"), F.transform("issues", lambda c: F.concat("version_id", F.lit(":"), c)).alias("_t"))
    texts = F.array_sort(F.flatten(F.collect_list("_t")))
    return found.agg(F.lit(version_id).alias("version_id"), F.coalesce(F.max(F.size("_i")) == 0, F.lit(False)).alias("valid"), F.count("*").alias("checked_versions"), texts.alias("issues"))
