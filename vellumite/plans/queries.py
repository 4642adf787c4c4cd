"""All queries of the library by name, with SQL that says what each must return.

Queries over PDFs read files planted from ``documents`` (:mod:`fixtures.planted`), whose
content follows from each row by arithmetic; so their SQL knows nothing of PDFs.
Parsing, inspecting and cleaning a planted corpus is done once a session and
table folder, and shared by the queries over it.
"""

from __future__ import annotations

from fixtures import planted
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sizes
from ..operators import inspect as I
from ..operators import objects as O
from ..operators import lengths, reach, sanitize, write
from ..streaming import ingest, sessions
from ..sources import sink
from ..sources.ranges import list_files
from ..sources.scratch import new_folder, stored
from ..sources.tables import newest, parse

FLAGSHIP = "q03_document_info"
_shared: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark: SparkSession, sf_dir: str, what: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by id: a table of one file, or of few row groups, would be planted and parsed by as few tasks
    return once(spark, sf_dir, "files", lambda: stored(planted.plant(table(spark, sf_dir, "documents").repartition("doc_id")), "planted", "zstd"))


def seen(spark: SparkSession, sf_dir: str) -> sanitize.Inspection:
    return once(spark, sf_dir, "seen", lambda: sanitize.inspect(files(spark, sf_dir)))


def cleaned(spark: SparkSession, sf_dir: str, level: int = 0) -> sanitize.Cleaned:
    return once(spark, sf_dir, f"cleaned {level}", lambda: sanitize.sanitize(files(spark, sf_dir), level=level, before=seen(spark, sf_dir)))


def q01_status(spark, sf_dir):
    return cleaned(spark, sf_dir).status.select("doc_id", "error_code")


def q02_outcome_counts(spark, sf_dir):
    return sanitize.outcomes(cleaned(spark, sf_dir).status)


def q03_document_info(spark, sf_dir):
    return seen(spark, sf_dir).findings.where("ord < 100").select("doc_id", "label", "value")


def q04_custom_info(spark, sf_dir):
    return seen(spark, sf_dir).findings.where(f"ord >= 100 and ord < {I.EMPTY_INFO}").select("doc_id", "label", "value")


def q05_page_count(spark, sf_dir):
    return seen(spark, sf_dir).status.where("error_code is null").select("doc_id", "pages")


def q06_flags(spark, sf_dir):
    return seen(spark, sf_dir).facts.select("doc_id", "has_info", "has_id", "catalog_xmp", "other_xmp", "piece_info", "script", "attachments", "profiles", "signed")


def q07_annotation_counts(spark, sf_dir):
    return seen(spark, sf_dir).facts.select("doc_id", F.col("annotations").alias("n"))


def q08_inventory(spark, sf_dir):
    return seen(spark, sf_dir).inventory.select("doc_id", "image_bytes", "metadata_bytes", "other_bytes", "recompressible_bytes")


def q09_findings_all(spark, sf_dir):
    return seen(spark, sf_dir).findings.select("doc_id", "ord", "category", "label", "value")


def q10_residuals(spark, sf_dir):
    return seen(spark, sf_dir).residuals


def q11_reachable(spark, sf_dir):
    return seen(spark, sf_dir).kept.where("obj >= 0 and node_id = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


def q12_graph_closure(spark, sf_dir):
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    down = nation.selectExpr("cast(n_regionkey as long) as src", "1000L + n_nationkey as dst")
    down = down.union(customer.selectExpr("1000L + c_nationkey", "1000000L + c_custkey")).union(orders.selectExpr("1000000L + o_custkey", "1000000000L + o_orderkey"))
    both = down.union(customer.selectExpr("1000000L + c_custkey", "1000L + c_nationkey"))
    regions = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as long) as origin")
    return reach.closure(both, regions.selectExpr("origin", "origin as node")).selectExpr("origin as doc_id", "node")


def q13_newest_wins(spark, sf_dir):
    """Events as cross-reference entries: users are files, event types objects, days sections."""
    kind = "case event_id % 4 when 0 then 1 when 1 then 2 else 0 end as priority"
    entries = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_type as obj", "datediff(date'2100-01-01', ts) as section_seq", kind, "event_id as place", "value")
    return newest(entries).selectExpr("doc_id", "obj", "section_seq", "priority", "place", "value")


def q14_sweep_semi(spark, sf_dir):
    """Customers as files: their open orders are linked from the trailer, and each order links its parts."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_custkey as doc_id", "o_orderkey as obj", "o_orderstatus as status")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as obj", "1000000000L + l_partkey as part").join(orders.drop("status"), "obj")
    ref = "'ref' as kind", "'k' as top_key"
    trailer = orders.where("status = 'O'").selectExpr("doc_id", "-1L as obj", "1 as node_id", *ref, "obj as ref_obj")
    own = orders.selectExpr("doc_id", "obj", "0 as node_id", "'dict' as kind", "cast(null as string) as top_key", "cast(null as long) as ref_obj")
    links = lines.selectExpr("doc_id", "obj", "1 as node_id", *ref, "part as ref_obj")
    parts = lines.selectExpr("doc_id", "part as obj", "0 as node_id", "'dict' as kind", "cast(null as string) as top_key", "cast(null as long) as ref_obj").distinct()
    kept = reach.sweep(trailer.unionByName(own).unionByName(links).unionByName(parts))
    return kept.where("obj >= 0 and node_id = 0").select("doc_id", "obj")


def q15_report_anti(spark, sf_dir):
    """Customers' segments as findings; those whose customer has filled orders are found again."""
    before = table(spark, sf_dir, "customer").selectExpr("c_custkey as doc_id", "1 as ord", "c_mktsegment as category", "'segment' as label", "cast(c_nationkey as string) as value")
    filled = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey as doc_id").distinct()
    return sanitize.removed(before, before.join(filled, "doc_id", "left_semi")).selectExpr("doc_id", "category", "value")


def q16_running_offsets(spark, sf_dir):
    """Suppliers' lines, thousands each, as the objects of a file."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", F.col("l_partkey").cast("string"))).cast("binary").alias("body"))
    return write.offsets(lines.selectExpr("l_suppkey as doc_id", "l_orderkey * 10 + l_linenumber as obj", "body"), 0).selectExpr("doc_id", "obj as line", "offset as start")


def q17_gap_fill(spark, sf_dir):
    placed = table(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy("l_orderkey", "l_linenumber").agg(F.lit(1).alias("offset"))
    slots = write.gaps(placed.selectExpr("l_orderkey as doc_id", "cast(l_linenumber as long) as obj", "offset", "0 as gen"))
    return slots.selectExpr("doc_id", "obj", "offset is null as free")


def synthetic_inventory(spark, sf_dir):
    """An inventory by arithmetic, for the estimator alone."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "(doc_id % 7) * n_chars * 9 as image_bytes", "(doc_id % 3) * 64 as metadata_bytes", "n_chars as other_bytes", "case when doc_id % 2 = 0 then (doc_id % 7) * n_chars * 9 else 0L end as recompressible_bytes", "n_chars * 70 + 1000 as file_bytes")


def q18_estimate_levels(spark, sf_dir):
    return sizes.estimates(synthetic_inventory(spark, sf_dir)).select("doc_id", "level", "bytes_low", "bytes_high", "confidence")


def q19_size_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sizes.size_label(F.col("n_chars") * F.expr("power(10, doc_id % 6)").cast("long")).alias("label"))


def q20_clean_findings(spark, sf_dir):
    return cleaned(spark, sf_dir).after.findings.select("doc_id", "label")


def q21_report(spark, sf_dir):
    rows = sanitize.report(cleaned(spark, sf_dir))
    return rows.selectExpr("doc_id", "coalesce(size(removed), 0) as removed_n", "replaced_file_id as replaced_id", "coalesce(size(left_behind), 0) as left_n", "coalesce(size(still_present), 0) as kept_n", "message")


def q22_page_bytes_sha(spark, sf_dir):
    after = cleaned(spark, sf_dir).after.tables
    content = after.nodes.where("depth = 1 and key = 'Contents' and kind = 'ref'").selectExpr("doc_id", "ref_obj as obj")
    streams = after.payloads.join(content, ["doc_id", "obj"])
    return streams.select("doc_id", F.sha2("payload", 256).alias("sha")).groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("pages"))


def q23_flate_packed(spark, sf_dir):
    return sanitize.report(cleaned(spark, sf_dir, 1), 1).select("doc_id", "streams_packed", "bytes_before", "bytes_after", "message")


def q24_jpeg_scrub(spark, sf_dir):
    return seen(spark, sf_dir).scrubbed.selectExpr("doc_id", "octet_length(payload) as bytes_after")


def q25_summary_lines(spark, sf_dir):
    return sanitize.summary(seen(spark, sf_dir))


def q26_error_text(spark, sf_dir):
    return cleaned(spark, sf_dir).status.where("error_code is not null").select("doc_id", sanitize.error_text(F.col("error_code")).alias("text"))


def q27_estimate_text(spark, sf_dir):
    rows = sizes.estimate_text(sizes.estimates(synthetic_inventory(spark, sf_dir)))
    original = synthetic_inventory(spark, sf_dir).select("doc_id", "file_bytes")
    return rows.join(original, "doc_id").select("doc_id", "level", "bytes_mid", "caption", sizes.savings(F.col("file_bytes"), F.col("bytes_mid")).alias("savings"))


def q50_estimate_display(spark, sf_dir):
    """Ranges as they are shown, of estimates and of exact sizes."""
    shown = sizes.estimate_text(sizes.estimates(synthetic_inventory(spark, sf_dir))).unionByName(sizes.estimate_text(q37_exact_probe(spark, sf_dir)))
    return shown.select("doc_id", "level", "method", "display", "caption")


def q28_output_names(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('/in/', source, '/doc.', doc_id, '.PDF') as path", "cast(doc_id % 8 - 2 as int) as level")
    return rows.select("doc_id", sizes.output_name(F.col("path"), F.col("level")).alias("name"))


def q29_target_pixels(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(1 + n_chars % 5000 as int) as w", "cast(1 + doc_id * 7 % 3000 as int) as h")
    width, height = sizes.target_pixels(F.col("w"), F.col("h"), 1600)
    return rows.select("doc_id", width.alias("width"), height.alias("height"))


def q30_image_counts(spark, sf_dir):
    return seen(spark, sf_dir).images


def q31_packable_streams(spark, sf_dir):
    return seen(spark, sf_dir).objects.where(O.packable()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("streams"), F.sum("payload_bytes").alias("bytes"))


def q32_review_texts(spark, sf_dir):
    return sanitize.review(seen(spark, sf_dir)).drop("text_note")


def q40_text_notes(spark, sf_dir):
    rows = sizes.derived(synthetic_inventory(spark, sf_dir)).select("doc_id", "text_heavy", F.explode(F.array(*(F.lit(i) for i in range(5)))).alias("level"))
    return rows.select("doc_id", "level", sizes.text_heavy_note(F.col("level"), F.col("text_heavy")).alias("note"))


def q41_images_recompressed(spark, sf_dir):
    done = cleaned(spark, sf_dir, 2)
    rows = sanitize.report(done, 2)
    sizes_ = done.after.objects.where(O.eligible()).groupBy("doc_id").agg(F.max("payload_bytes").alias("largest"), F.max("width").alias("width"))
    smaller = F.col("largest") < len(planted.PHOTO)
    return rows.join(sizes_, "doc_id", "left").select("doc_id", "images_recompressed", "image_count", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce(smaller, F.lit(True)).alias("smaller"), (F.col("message").contains("re-encoded")).alias("told"))


def q42_integers(spark, sf_dir):
    return O.integers(seen(spark, sf_dir).tables.nodes, "Count").select("doc_id", "value")


def q43_versions(spark, sf_dir):
    return cleaned(spark, sf_dir).after.tables.docs.select("doc_id", "major", "minor")


def q33_inspection_rows(spark, sf_dir):
    rows = sanitize.inspection_rows(files(spark, sf_dir), seen(spark, sf_dir))
    told = lambda c: F.array_join(F.transform(c, lambda e: e["label"]), "; ").alias(c)
    columns = "doc_id", "pages", "encrypted", "signed", "title", "author", "subject", "keywords", "annotations", "jpegs_with_metadata", "empty_signature_fields", "images", "recompressible_images", "metadata_bytes"
    return rows.select(*columns, told("findings"), F.coalesce(told("residuals"), F.lit("")).alias("residuals"))


def q34_reached_is_written(spark, sf_dir):
    nodes = cleaned(spark, sf_dir).after.tables.nodes
    written, reached = nodes.where("obj >= 0 and node_id = 0").select("doc_id", "obj"), reach.reachable(nodes)
    both = written.withColumn("w", F.lit(1)).join(reached.withColumn("r", F.lit(1)), ["doc_id", "obj"], "full")
    return both.groupBy("doc_id").agg(F.count("w").alias("written"), F.count("r").alias("reached"), F.count_if(F.expr("w is null or r is null")).alias("differ"))


def q44_exact_sizes(spark, sf_dir):
    """Sizes of cleaned files from lengths alone, at level 0."""
    return lengths.exact_sizes(seen(spark, sf_dir), levels=(0,)).select("doc_id", "length")


def q45_exact_probe_levels(spark, sf_dir):
    """Sizes told from lengths, against what a clean at levels 0 to 2 writes."""
    made = [cleaned(spark, sf_dir, i).files.selectExpr("doc_id", f"{i} as level", "length as written") for i in (0, 1, 2)]
    # after the cleans, whose packed streams it measures
    told = lengths.exact_sizes(seen(spark, sf_dir), levels=(0, 1, 2))
    both = told.join(made[0].unionByName(made[1]).unionByName(made[2]), ["doc_id", "level"], "full")
    return both.selectExpr("doc_id", "level", "length <=> written as equal")


def offered(spark, sf_dir):
    """Files offered: users are sessions, events urls; every other url is local."""
    url = "concat(case event_id % 3 when 0 then 'https://host/' when 1 then 'file:///in/' else 'FILE:///in/' end, event_id, '.pdf') as url"
    phase = "element_at(array('idle', 'inspecting', 'review', 'working', 'done', 'failed'), cast(event_id div 50 % 6 as int) + 1) as phase"
    return table(spark, sf_dir, "events").selectExpr("user_id as session", "event_id div 50 as offer", "event_id as place", url, phase)


def q35_first_local_file(spark, sf_dir):
    return ingest.to_review(offered(spark, sf_dir))


def arriving_events(spark, sf_dir):
    """The events as a stream; a pattern, as the table may be one file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


#: Milliseconds that a choice waits in q46, whose events are hours apart.
QUERY_WAIT = 6 * 3600 * 1000


def q46_debounced_choices(spark, sf_dir):
    """Users are sessions, events choices of a level, in event time."""
    choices = arriving_events(spark, sf_dir).selectExpr("user_id as session", "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01', ts) as generation", "cast(ts as timestamp) as at").withWatermark("at", "0 seconds")
    choices = choices.withColumn("level", F.expr("cast(generation % 5 as int)"))
    return sessions.drained(sessions.debounced(choices, QUERY_WAIT, "at"), new_folder(spark, "debounced"))


def q47_offers_by_phase(spark, sf_dir):
    """Users are sessions; every fourth event changes the phase, the others offer a url."""
    phase = "case when event_id % 4 = 0 then element_at(array('idle', 'inspecting', 'review', 'working', 'done', 'failed'), cast(event_id div 4 % 6 as int) + 1) end as phase"
    url = "case when event_id % 4 > 0 then concat(case event_id % 3 when 0 then 'https://host/' when 1 then 'file:///in/' else 'FILE:///in/' end, event_id, '.pdf') end as url"
    rows = arriving_events(spark, sf_dir).selectExpr("user_id as session", "event_id as place", phase, url)
    return sessions.drained(sessions.taken_offers(rows), new_folder(spark, "offers"))


def q48_deep_closure(spark, sf_dir):
    """All events as one chain in the order of their ids, with a few ways out; regions start along it."""
    events = table(spark, sf_dir, "events")
    edges = events.selectExpr("event_id as src", "event_id + 1 as dst").unionByName(events.where("event_id % 10000 = 5000").selectExpr("event_id as src", "-event_id as dst"))
    most = events.agg(F.max("event_id")).first()[0] or 0
    starts = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as long) as origin", f"r_regionkey * {most}L div 5 as node")
    return reach.closure(edges, starts).selectExpr("origin as doc_id", "node")


def q49_folder_by_ranges(spark, sf_dir):
    """The files in folders, written by the committed sink, listed, and read by ranges."""
    folder = new_folder(spark, "folder")
    sink.write_files(files(spark, sf_dir).selectExpr("doc_id", "concat('d', doc_id % 7, '/', doc_id, '.pdf') as name", "content"), folder)
    found = list_files(spark, folder)
    tables = parse(found)
    paths = found.selectExpr("doc_id", "cast(regexp_extract(path, '([0-9]+).pdf$', 1) as long) as number")
    told = paths.join(I.with_pages(tables), "doc_id").join(tables.taken, "doc_id", "left")
    return told.selectExpr("number as doc_id", "error_code", "pages", "coalesce(bytes_read > 0, false) as read")


def q36_within_band(spark, sf_dir):
    rows = sizes.estimates(synthetic_inventory(spark, sf_dir)).withColumn("actual", F.expr("bytes_high * (1 + doc_id % 5) div 3"))
    return rows.select("doc_id", "level", "actual", sizes.within_band(F.col("actual"), F.col("bytes_low"), F.col("bytes_high"), F.when(F.col("doc_id") % 2 == 0, "exact").otherwise("heuristic")).alias("inside"))


def q37_exact_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "cast(n_chars * 7 as long) as length", "cast(n_chars as long) * 30000 as input_bytes", "2 as level")
    return sizes.probed(rows)


def q38_latest_choice(spark, sf_dir):
    choices = table(spark, sf_dir, "events").selectExpr("user_id as session", "event_id as generation", "cast(event_id * 7 % 5 as int) as level")
    return ingest.latest_choice(choices)


def q39_plain_reals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", I.plain_real("l_extendedprice").alias("price"), I.plain_real(F.col("l_discount") * 1e-6).alias("small"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:1] == "q" and k[1:3].isdigit()}

GOOD = """
    rows as (select *, case when doc_id % 59 = 51 then 'oversize' when doc_id % 31 = 5 then 'emptyInput' when doc_id % 37 = 5 then 'notPDF' when doc_id % 59 in (46, 47) then 'unsupported' when doc_id % 59 in (42, 45, 49, 50) then 'corrupt' when doc_id % 23 = 0 then 'corrupt' when doc_id % 17 = 0 then 'encrypted' when doc_id % 41 = 7 then 'corrupt' end as bad,
                    doc_id % 19 = 0 or doc_id % 47 = 3 as signed, doc_id % 43 = 3 as no_info,
                    doc_id % 4 as notes, 1 + doc_id % 3 as pages, (doc_id // 5) % 2 = 0 as has_id, case when doc_id % 24 = 0 then 3 when doc_id % 12 = 0 then 1 else 0 end as images, (doc_id % 36 = 0)::int as photos from documents),
    good as (select * from rows where bad is null),
    clean as (select * from good where not signed)"""

FINDINGS = f"""
    findings as (
        select doc_id, 0 as ord, 'Document info' as category, 'Title' as label, 'doc-' || doc_id as value from good where not no_info
        union all select doc_id, 1, 'Document info', 'Author', source from good where not no_info
        union all select doc_id, 2, 'Document info', 'Subject', lang from good where doc_id % 2 = 0 and not no_info
        union all select doc_id, 101, 'Document info', 'XChars', cast(n_chars as varchar) from good where doc_id % 3 = 0 and not no_info
        union all select doc_id, {I.EMPTY_INFO}, 'Document info', 'Info dictionary', 'Present (empty fields)' from good where no_info
        union all select doc_id, {I.FLAGS}, 'XMP / streams', 'Catalog XMP metadata', 'Present' from good where doc_id % 4 = 0
        union all select doc_id, {I.FLAGS + 1}, 'XMP / streams', 'Page or object XMP metadata', 'Present' from good where doc_id % 6 = 0
        union all select doc_id, {I.FLAGS + 2}, 'XMP / streams', 'Application private data (PieceInfo)', 'Present' from good where doc_id % 7 = 0
        union all select doc_id, {I.FLAGS + 3}, 'File identity', 'Trailer file ID', 'Links copies of this file; replaced with a random one' from good where has_id
        union all select doc_id, {I.FLAGS + 4}, 'Annotations', 'Annotation authors / dates', notes || case when notes = 1 then ' annotation' else ' annotations' end from good where notes > 0
        union all select doc_id, {I.FLAGS + 5}, 'Images', 'JPEG EXIF / XMP / IPTC', images || case when images = 1 then ' image stream' else ' image streams' end from good where images > 0
        union all select doc_id, {I.FLAGS + 6}, 'Security', 'Digital signature', 'Detected: this file is not modified' from good where signed),
    stays as (
        select doc_id, 'JavaScript' as label, 'Scripts are not removed' as value from good where doc_id % 11 = 0
        union all select doc_id, 'Attached files', 'Attachments and their contents are not removed' from good where doc_id % 13 = 0
        union all select doc_id, 'Color profiles', 'ICC profiles and output intents are not removed' from good where doc_id % 10 = 0
        union all select doc_id, 'Empty signature field', '1 unsigned field, kept as is' from good where doc_id % 9 = 0 and not signed)"""

KEPT = "4 + 2 * pages + notes + (doc_id % 11 = 0)::int + 2 * (doc_id % 13 = 0)::int + 2 * (doc_id % 10 = 0)::int + (doc_id % 9 = 0)::int + images + photos + (doc_id % 19 = 0)::int + 2 * (doc_id % 6 = 1)::int + 600 * (doc_id % 97 = 3)::int"


def estimate_sql() -> str:
    """The estimator's arithmetic in SQL, a common table expression ``est`` (doc_id, level, bytes_low, bytes_high, confidence, file_bytes)."""
    d = lambda x: f"{x}::double"
    steps = ["inv as (select doc_id, (doc_id % 7) * n_chars * 9 as image, (doc_id % 3) * 64 as meta, n_chars as other, case when doc_id % 2 = 0 then (doc_id % 7) * n_chars * 9 else 0 end as again, n_chars * 70 + 1000 as file from documents)"]
    steps.append("a as (select *, greatest(0, file - image - meta - other) as over_, case when file > 0 then image::double / file else 0 end < 0.15::double as heavy, greatest(1, file)::double as o, least(image, again)::double as s from inv)")
    steps.append(f"r0 as (select *, least(greatest(o - (meta * {d(0.95)} + o * {d(0.01)}), o * {d(0.85)}), o * {d(1.06)}) as x0 from a)")
    for n in range(1, 5):
        (other, overhead), (small, large) = sizes.KEPT[n], sizes.IMAGES_KEPT[n]
        raw = f"s * (case when s >= {sizes.LARGE_IMAGES} then {d(large)} else {d(small)} end) + (image::double - s) + other * {d(other)} + meta * {d(0.02)} + over_ * {d(overhead)}"
        raw = f"case when heavy then greatest({raw}, x0 * {d(sizes.TEXT_FLOORS[n])}) else {raw} end" if n in sizes.TEXT_FLOORS else raw
        steps.append(f"r{n} as (select *, {raw} as y{n} from r{n - 1})")
    last = "r4"
    for n in range(1, 5):
        prev = "x0" if n == 1 else f"z{n - 1}"
        steps.append(f"t{n} as (select *, least(greatest(least(y{n}, {prev} * {d(0.999)}), o * {d(0.001)}), o * {d(1.08)}) as z{n} from {last})")
        last = f"t{n}"
    steps.append(f"u0 as (select *, least(greatest(x0, o * {d(0.001)}), o * {d(1.08)}) as m0, trunc(o * {d(1.05)})::bigint as cap from {last})")
    for n in range(1, 5):
        steps.append(f"u{n} as (select *, case when z{n} > m{n - 1} then m{n - 1} * {d(0.998)} else z{n} end as m{n} from u{n - 1})")
    last = "u4"
    for n in range(5):
        (heavy, light), (sure, unsure) = sizes.BANDS[min(n, 2)], sizes.CONFIDENCE[min(n, 2)]
        band = f"case when heavy then {d(heavy)} else {d(light)} end"
        low = f"least(greatest(1, round(m{n} * (1::double - ({band})))::bigint), cap)"
        high = f"least(greatest({low}, round(m{n} * (1::double + ({band})))::bigint), cap)"
        high = f"least({high}, h{n - 1})" if n else high
        steps.append(f"v{n} as (select *, {high} as h{n}, {low} as lo{n}, case when heavy then {d(sure)} else {d(unsure)} end as c{n} from {last})")
        last = f"v{n}"
    rows = " union all ".join(f"select doc_id, {n} as level, least(lo{n}, h{n}) as bytes_low, h{n} as bytes_high, c{n} as confidence, file as file_bytes from v4" for n in range(5))
    return ", ".join([*steps, f"est as ({rows})"])


def label_sql(n: str) -> str:
    cases = [f"when {n} < 1000 then {n} || ' bytes'"]
    for unit, size, places in (("KB", 1e3, 1), ("MB", 1e6, 1), ("GB", 1e9, 2)):
        value = f"({n}::double / {int(size)})"
        limit = f"{value} < 1000 and" if unit != "GB" else ""
        cases += [f"when {limit} {value} >= 100 then printf('%.0f {unit}', {value})", f"when {limit} true then printf('%.{places}f {unit}', {value})"]
    return "case " + " ".join(cases) + " end"


def stream_sql(keys: str, n: str) -> str:
    """Bytes of a stream of ``n`` bytes whose dictionary has ``keys``."""
    return f"length('<< {keys}/Length ' || {n} || ' >>') + {n} + {len(write.STREAM + write.ENDSTREAM)}"


_IMAGE = "/BitsPerComponent 8 /ColorSpace /DeviceRGB /Height {0} /Subtype /Image /Type /XObject /Width {1} /Filter {2} "

#: What the cleaned file of each row takes up: objects by number, (doc_id, obj, n), from the planter's rules.
SIZES = f"""
    nums as (select *, 4 + notes as w, doc_id % 6 = 0 as xmp, doc_id % 6 = 1 as far, doc_id % 97 = 3 as deep from clean),
    nums1 as (select *, w + images + photos as p0 from nums),
    nums2 as (select *, p0 + 2 * pages + xmp::int as e0 from nums1),
    nums3 as (select *, e0 + 2 * far::int as e1, e0 + 2 * far::int + 600 * deep::int as e2 from nums2),
    nums4 as (select *, e2 + (doc_id % 4 = 0)::int + (doc_id % 7 = 0)::int as e4 from nums3),
    nums5 as (select *, e4 + (doc_id % 11 = 0)::int as e5 from nums4),
    nums6 as (select *, e5 + 2 * (doc_id % 13 = 0)::int as e6 from nums5),
    nums7 as (select *, e6 + 2 * (doc_id % 10 = 0)::int as e7 from nums6),
    sheets as (select *, unnest(range(pages)) as i from nums7),
    sheets1 as (select *, p0 + 1 + 2 * i + (i > 0 and xmp)::int as c, p0 + 2 + 2 * i + xmp::int as p from sheets),
    kids as (select doc_id, string_agg(p || ' 0 R', ' ' order by i) as kids from sheets1 group by 1),
    held as (
        select doc_id, 1 as obj, length('<< ' || case when doc_id % 13 = 0 then '/AF [' || e6 || ' 0 R] ' else '' end || case when doc_id % 9 = 0 then '/AcroForm << /Fields [' || (e7 + 1) || ' 0 R] >> ' else '' end
            || case when doc_id % 59 = 44 then '/Font 3 3000000000 R ' else '' end || case when doc_id % 11 = 0 then '/OpenAction ' || e5 || ' 0 R ' else '' end || case when deep then '/Outlines ' || e2 || ' 0 R ' else '' end
            || case when doc_id % 10 = 0 then '/OutputIntents [' || e7 || ' 0 R] ' else '' end || '/Pages 2 0 R /Type /Catalog >>') as n from nums7
        union all select doc_id, 2, length('<< ' || case when far then '/Count ' || e1 || ' 0 R /Kids ' || (e1 - 1) || ' 0 R' else '/Count ' || pages || ' /Kids [' || kids || ']' end || ' /Type /Pages >>') from nums7 join kids using (doc_id)
        union all select doc_id, 3, length('<< /BaseFont /Helvetica /Subtype /Type1 /Type /Font >>') from clean
        union all select doc_id, 3 + unnest(range(1, notes + 1)), length('<< /Rect [0 0 9 9] /Subtype /Text /Type /Annot >>') from nums7
        union all select doc_id, w, length('<< /Rect [0 0 9 9] /Subtype /Widget /T (field) /Type /Annot >>') from nums7
        union all select doc_id, w + 1, {stream_sql(_IMAGE.format(8, 8, "' || case when doc_id % 24 = 0 then '/DCTDecode' else '[/DCTDecode]' end || '"), '156')} from nums7 where images > 0
        union all select doc_id, w + 2, {stream_sql(_IMAGE.format(8, 8, '/DCTDecode'), '156')} from nums7 where images = 3
        union all select doc_id, w + 3, {stream_sql(_IMAGE.format(8, 8, '/DCTDecode') + "/SMask ' || (w + 2) || ' 0 R ", '156')} from nums7 where images = 3
        union all select doc_id, p0, {stream_sql(_IMAGE.format(120, 160, '/DCTDecode'), str(len(planted.PHOTO)))} from nums7 where photos = 1
        union all select doc_id, c, {stream_sql('', 'strlen(text)')} from sheets1
        union all select doc_id, p, length('<< ' || case when i = 0 then '/Annots [' || array_to_string(list_transform(range(4, w + 1), lambda x: x || ' 0 R'), ' ') || '] ' else '' end || '/Contents ' || c || ' 0 R /MediaBox [0 0 612 792] /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> '
            || case when images > 0 then '/XObject << /Im1 ' || (w + 1) || ' 0 R ' || case when images = 3 then '/Im2 ' || (w + 3) || ' 0 R ' else '' end || case when photos = 1 then '/Photo ' || p0 || ' 0 R ' else '' end || '>> ' else '' end || '>> /Type /Page >>') from sheets1
        union all select doc_id, e1 - 1, length('[' || kids || ']') from nums7 join kids using (doc_id) where far
        union all select doc_id, e1, length(pages::varchar) from nums7 where far
        union all select doc_id, e1 + 1, length('<< /Last true >>') from nums7 where deep
        union all select doc_id, x, length('<< /Next ' || (x - 1) || ' 0 R >>') from (select doc_id, e1 + unnest(range(2, 601)) as x from nums7 where deep)
        union all select doc_id, e5, length('<< /JS (app.beep\\(\\)) /S /JavaScript >>') from nums7 where doc_id % 11 = 0
        union all select doc_id, e6 - 1, {stream_sql('/Type /EmbeddedFile ', '32')} from nums7 where doc_id % 13 = 0
        union all select doc_id, e6, length('<< /EF << /F ' || (e6 - 1) || ' 0 R >> /F (a.txt) /Type /Filespec >>') from nums7 where doc_id % 13 = 0
        union all select doc_id, e7 - 1, {stream_sql('/N 3 ', '16')} from nums7 where doc_id % 10 = 0
        union all select doc_id, e7, length('<< /DestOutputProfile ' || (e7 - 1) || ' 0 R /Type /OutputIntent >>') from nums7 where doc_id % 10 = 0
        union all select doc_id, e7 + 1, length('<< /FT /Sig /T (sign here) >>') from nums7 where doc_id % 9 = 0),
    bodies as (select doc_id, 15 + sum(n + length(obj || ' 0 obj') + 9)::bigint as body, max(obj) + 1 as size from held group by 1),
    sized as (select doc_id, body + length('xref' || chr(10) || '0 ' || size) + 1 + 20 * size + 8 + length('<< /ID [' || repeat('<' || repeat('A', 32) || '> ', 2)) - 1 + length('] /Root 1 0 R /Size ' || size || ' >>') + 11 + length(body::varchar) + 7 as length from bodies)"""


ORACLES = {
    "q01_status": f"with {GOOD} select doc_id, case when bad is not null then bad when signed then 'signed' end as error_code from rows",
    "q02_outcome_counts": f"with {GOOD} select case when bad is not null then bad when signed then 'signed' else 'cleaned' end as outcome, count(*) as n from rows group by 1",
    "q03_document_info": f"with {GOOD}, {FINDINGS} select doc_id, label, value from findings where ord < 100",
    "q04_custom_info": f"with {GOOD}, {FINDINGS} select doc_id, label, value from findings where ord >= 100 and ord < {I.EMPTY_INFO}",
    "q05_page_count": f"with {GOOD} select doc_id, cast(pages as int) as pages from good",
    "q06_flags": f"with {GOOD} select doc_id, true as has_info, has_id, doc_id % 4 = 0 as catalog_xmp, doc_id % 6 = 0 as other_xmp, doc_id % 7 = 0 as piece_info, doc_id % 11 = 0 as script, doc_id % 13 = 0 as attachments, doc_id % 10 = 0 as profiles, signed from good",
    "q07_annotation_counts": f"with {GOOD} select doc_id, notes as n from good",
    "q08_inventory": f"with {GOOD} select doc_id, 200 * images::bigint + {len(planted.PHOTO)} * photos::bigint as image_bytes, 64 * (doc_id % 4 = 0)::bigint + 64 * (doc_id % 6 = 0)::bigint as metadata_bytes, pages * strlen(text) + 32 * (doc_id % 13 = 0)::bigint + 16 * (doc_id % 10 = 0)::bigint as other_bytes, 200 * ((doc_id % 12 = 0)::bigint + (doc_id % 24 = 0)::bigint) + {len(planted.PHOTO)} * photos::bigint as recompressible_bytes from good",
    "q09_findings_all": f"with {GOOD}, {FINDINGS} select * from findings",
    "q10_residuals": f"with {GOOD}, {FINDINGS} select * from stays",
    "q11_reachable": f"with {GOOD} select doc_id, {KEPT} as kept from good",
    "q12_graph_closure": """
        with recursive edges as (
            select n_regionkey::bigint as src, 1000 + n_nationkey::bigint as dst from nation
            union all select 1000 + c_nationkey::bigint, 1000000 + c_custkey from customer
            union all select 1000000 + o_custkey, 1000000000 + o_orderkey from orders
            union all select 1000000 + c_custkey, 1000 + c_nationkey::bigint from customer),
        walk as (select r_regionkey::bigint as doc_id, r_regionkey::bigint as node from region
                 union select doc_id, dst from walk join edges on node = src)
        select doc_id, node from walk""",
    "q13_newest_wins": """
        with entries as (select user_id as doc_id, event_type as obj, date_diff('day', ts::date, date '2100-01-01')::int as section_seq, (case event_id % 4 when 0 then 1 when 1 then 2 else 0 end)::int as priority, event_id as place, value from events),
        lasts as (select * from entries qualify row_number() over (partition by doc_id, obj, section_seq, priority = 1 order by place desc) = 1)
        select * from lasts qualify row_number() over (partition by doc_id, obj order by section_seq, priority) = 1""",
    "q14_sweep_semi": """
        with held as (select o_custkey as doc_id, o_orderkey as obj from orders where o_orderstatus = 'O')
        select doc_id, obj from held union select doc_id, 1000000000 + l_partkey from held join lineitem on l_orderkey = obj""",
    "q15_report_anti": "select c_custkey as doc_id, c_mktsegment as category, c_nationkey::varchar as value from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "q16_running_offsets": """
        with parts as (select l_suppkey as doc_id, l_orderkey * 10 + l_linenumber as line, min(l_returnflag || l_partkey) as body from lineitem group by 1, 2)
        select doc_id, line, cast(coalesce(sum(strlen(body)) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 0) as bigint) as start from parts""",
    "q17_gap_fill": """
        with placed as (select distinct l_orderkey as doc_id, l_linenumber::bigint as obj from lineitem where l_quantity > 25),
        slots as (select doc_id, unnest(generate_series(0, max(obj))) as obj from placed group by doc_id)
        select s.doc_id, s.obj, p.obj is null as free from slots s left join placed p on s.doc_id = p.doc_id and s.obj = p.obj""",
    "q18_estimate_levels": f"with {estimate_sql()} select doc_id, level, bytes_low, bytes_high, confidence from est",
    "q19_size_label": f"with n as (select doc_id, n_chars * power(10, doc_id % 6)::bigint as n from documents) select doc_id, {label_sql('n')} as label from n",
    "q20_clean_findings": f"with {GOOD} select doc_id, 'Trailer file ID' as label from clean",
    "q21_report": f"""
        with {GOOD}, {FINDINGS},
        gone as (select doc_id, count(*) as n from findings where label <> 'Trailer file ID' and category <> 'Security' group by 1),
        kept as (select doc_id, count(*) as n, string_agg(label, ', ' order by label) as labels from stays group by 1),
        told as (select c.doc_id, coalesce(g.n, 0)::int as removed_n, has_id as replaced_id, coalesce(k.n, 0)::int as kept_n, labels from clean c left join gone g using (doc_id) left join kept k using (doc_id))
        select doc_id, removed_n, replaced_id, 0 as left_n, kept_n,
               'Removed ' || (removed_n + replaced_id::int) || ' metadata item' || case when removed_n + replaced_id::int = 1 then '' else 's' end || ' from this copy. '
               || case when kept_n > 0 then 'Still in the file: ' || labels || '. ' else '' end || 'Your original file was not changed.' as message
        from told""",
    "q22_page_bytes_sha": f"with {GOOD} select doc_id, sha256(text) as sha, pages from clean",
    "q24_jpeg_scrub": f"with {GOOD} select doc_id, 156 as bytes_after from good join (values (1), (2), (3)) t(i) on i <= images",
    "q25_summary_lines": f"""
        with {GOOD}, {FINDINGS},
        gone as (select doc_id, count(*) as n from findings where category <> 'Security' group by 1),
        kept as (select doc_id, 'Stays in the file: ' || string_agg(label, ', ' order by label) || '.' as residual_line from stays group by 1)
        select g.doc_id, pages || ' page' || case when pages = 1 then '' else 's' end || case when signed then ' · signed' else ' · ' || n || ' metadata item' || case when n = 1 then '' else 's' end || ' to remove' end as summary_line, residual_line
        from good g join gone using (doc_id) left join kept using (doc_id)""",
    "q26_error_text": f"with {GOOD} select doc_id, case when bad in ('emptyInput', 'notPDF') then 'Not a PDF.' when bad = 'corrupt' then 'This PDF is damaged or incomplete.' when bad = 'encrypted' then 'PDF is password-protected.' when bad = 'oversize' then 'PDF is too large.' when bad = 'unsupported' then 'This PDF uses a structure that cannot be read.' else 'Signed PDFs are not modified.' end as text from rows where bad is not null or signed",
    "q27_estimate_text": f"""
        with {estimate_sql()}, mid as (select *, (bytes_low + bytes_high) // 2 as bytes_mid from est),
        share as (select *, round((file_bytes - bytes_mid)::double / file_bytes * 100)::bigint as pct from mid)
        select doc_id, level, bytes_mid, case when confidence >= 0.8 then 'Estimate' when confidence >= 0.6 then 'Rough estimate' else 'Rough estimate — actual may differ' end as caption,
               case when bytes_mid < file_bytes and pct >= 1 then '−' || pct || '%' end as savings from share""",
    "q50_estimate_display": f"""
        with {estimate_sql()}, probe as (select doc_id, 2 as level, greatest(1, n - greatest(32, n // 100)) as bytes_low, n + greatest(32, n // 100) as bytes_high, 0.98::double as confidence, 'exact' as method
            from (select doc_id, n_chars * 7 as n, n_chars * 30000 as input_bytes from documents) where input_bytes > 0 and input_bytes <= 15728640),
        both_ as (select doc_id, level, bytes_low, bytes_high, confidence, 'heuristic' as method from est union all select * from probe),
        told as (select *, {label_sql('bytes_low')} as lo, {label_sql('bytes_high')} as hi, {label_sql('((bytes_low + bytes_high) // 2)')} as mid, (bytes_high - bytes_low)::double / greatest(1, bytes_high) as span from both_)
        select doc_id, level, method, case when bytes_high <= 0 then '0 bytes' when method = 'exact' and (lo = hi or span < 0.04) then mid when span < 0.08 or lo = hi then '~' || hi else '~' || lo || '–' || hi end as display,
               case when method = 'exact' then 'Measured from a dry-run export' when confidence >= 0.8 then 'Estimate' when confidence >= 0.6 then 'Rough estimate' else 'Rough estimate — actual may differ' end as caption from told""",
    "q28_output_names": "select doc_id, 'doc.' || doc_id || '-' || case greatest(0, least(4, doc_id % 8 - 2)) when 0 then 'clean' when 1 then 'clean-light' when 2 then 'clean-balanced' when 3 then 'clean-strong' else 'clean-max' end || '.pdf' as name from documents",
    "q29_target_pixels": "with s as (select doc_id, (1 + n_chars % 5000)::int as w, (1 + doc_id * 7 % 3000)::int as h from documents), t as (select *, least(1::double, 1600::double / greatest(w, h)) as k from s) select doc_id, greatest(1, round(w * k)::int) as width, greatest(1, round(h * k)::int) as height from t",
    "q30_image_counts": f"with {GOOD} select doc_id, images + photos as images, 1 + photos as eligible from good where images > 0",
    "q31_packable_streams": f"with {GOOD} select doc_id, pages as streams, pages * strlen(text) as bytes from good where strlen(text) >= 64",
    "q32_review_texts": f"""
        with {GOOD}, {FINDINGS},
        gone as (select doc_id, count(*) as n from findings where category <> 'Security' group by 1),
        told as (select g.doc_id, images + photos as images, 1 + photos as eligible, coalesce(n, 0) as n, unnest(range(5))::int as level from good g left join gone using (doc_id))
        select doc_id, level,
               case when n > 0 then case level when 0 then 'Remove metadata and save…' when 1 then 'Remove metadata, pack and save…' else 'Remove metadata, compress and save…' end
                    else case level when 0 then 'Save a rewritten copy…' when 1 then 'Pack and save…' else 'Compress and save…' end end as action,
               case when level < 2 then null when images = 0 then 'This PDF has no images, so this level does nothing more than Light.'
                    else eligible || ' of ' || images || ' image' || case when images = 1 then '' else 's' end || ' in this PDF can be re-encoded.' end as scope_note
        from told""",
    "q41_images_recompressed": f"with {GOOD} select doc_id, photos as images_recompressed, images + photos as image_count, case when photos = 1 then 160 when images > 0 then 8 else 0 end::bigint as width, true as smaller, photos = 1 as told from clean",
    "q44_exact_sizes": f"with {GOOD}, {SIZES} select doc_id, length from sized",
    "q45_exact_probe_levels": f"with {GOOD} select doc_id, unnest(range(3))::int as level, true as equal from clean",
    "q42_integers": f"with {GOOD} select doc_id, pages as value from good",
    "q43_versions": f"with {GOOD} select doc_id, case when doc_id % 59 = 41 then 2 else 1 end as major, case when doc_id % 59 = 41 then 0 when doc_id % 5 < 2 then 4 else 5 end as minor from clean",
    "q40_text_notes": f"with {estimate_sql()} select doc_id, unnest(range(5))::int as level, case when level >= 2 and heavy then 'This PDF is mostly text/vectors — compression won’t shrink much.' end as note from a",
    "q33_inspection_rows": f"""
        with {GOOD}, {FINDINGS},
        told as (select doc_id, string_agg(label, '; ' order by ord) as findings from findings group by 1),
        kept as (select doc_id, string_agg(label, '; ' order by label) as residuals from stays group by 1)
        select g.doc_id, pages::int as pages, false as encrypted, signed, case when not no_info then 'doc-' || g.doc_id end as title, case when not no_info then source end as author,
               case when g.doc_id % 2 = 0 and not no_info then lang end as subject, null::varchar as keywords, notes as annotations, images as jpegs_with_metadata,
               case when signed then 0 else (g.doc_id % 9 = 0)::int end as empty_signature_fields, images + photos as images, (images > 0)::int + photos as recompressible_images,
               64 * (g.doc_id % 4 = 0)::bigint + 64 * (g.doc_id % 6 = 0)::bigint as metadata_bytes, findings, coalesce(residuals, '') as residuals
        from good g join told using (doc_id) left join kept using (doc_id)
        union all select doc_id, 0, true, false, null, null, null, null, 0, 0, 0, 0, 0, 0, 'Encryption', '' from rows where bad = 'encrypted'""",
    "q34_reached_is_written": f"with {GOOD} select doc_id, {KEPT} as written, {KEPT} as reached, 0 as differ from clean",
    "q35_first_local_file": """
        with told as (select user_id as session, event_id // 50 as offer, event_id as place, case event_id % 3 when 0 then 'https://host/' when 1 then 'file:///in/' else 'FILE:///in/' end || event_id || '.pdf' as url, event_id // 50 % 6 as phase from events)
        select session, offer, min_by(url, place) as url from told where url ilike 'file:%' and phase not in (1, 3) group by 1, 2""",
    "q46_debounced_choices": f"""
        with c as (select distinct user_id as session, date_diff('microsecond', timestamp '2024-01-01', ts) as generation from events),
        n as (select *, lead(generation) over (partition by session order by generation) as next, max(generation) over () as last from c)
        select session, generation, cast(generation % 5 as int) as level from n where coalesce(next, last) // 1000 - generation // 1000 >= {QUERY_WAIT}""",
    "q47_offers_by_phase": """
        with e as (select user_id as session, event_id as place, case when event_id % 4 = 0 then event_id // 4 % 6 end as phase, case event_id % 3 when 0 then 'https://host/' when 1 then 'file:///in/' else 'FILE:///in/' end || event_id || '.pdf' as url from events),
        now as (select *, coalesce(last_value(phase ignore nulls) over (partition by session order by place), 0) as held from e)
        select session, place, url from now where phase is null and url ilike 'file:%' and held not in (1, 3)""",
    "q48_deep_closure": """
        with m as (select max(event_id) as most from events), r as (select r_regionkey::bigint as doc_id, r_regionkey * most // 5 as start from region, m)
        select doc_id, event_id as node from r join events on event_id >= start
        union all select doc_id, most + 1 from r, m
        union all select doc_id, -event_id from r join events on event_id >= start and event_id % 10000 = 5000""",
    "q49_folder_by_ranges": f"with {GOOD} select doc_id, case when bad = 'oversize' then 'emptyInput' else bad end as error_code, case when bad is null then pages end::int as pages, coalesce(bad, '') not in ('oversize', 'emptyInput') as read from rows",
    "q36_within_band": f"""
        with {estimate_sql()}, told as (select *, bytes_high * (1 + doc_id % 5) // 3 as actual, (bytes_low + bytes_high) // 2 as mid from est)
        select doc_id, level, actual, case when actual between bytes_low and bytes_high then true when mid <= 0 then false
               when doc_id % 2 = 0 then abs(actual - mid)::double / mid <= 0.05 else abs(actual - mid)::double / mid <= 0.55 or (actual <= bytes_high and actual >= bytes_low // 2) end as inside from told""",
    "q37_exact_probe": """
        select doc_id, 2 as level, greatest(1, n - greatest(32, n // 100)) as bytes_low, n + greatest(32, n // 100) as bytes_high, 0.98::double as confidence, 'exact' as method
        from (select doc_id, n_chars * 7 as n, n_chars * 30000 as input_bytes from documents) where input_bytes > 0 and input_bytes <= 15728640""",
    "q38_latest_choice": "select user_id as session, max_by((event_id * 7 % 5)::int, event_id) as level from events group by 1",
    "q39_plain_reals": """
        select l_orderkey, l_linenumber, regexp_replace(l_extendedprice::varchar, '\\.0$', '') as price,
               case when l_discount = 0 then '0' else rtrim(printf('%.20f', round(l_discount * 100) / 1e8)[1:10], '0') end as small from lineitem""",
}
