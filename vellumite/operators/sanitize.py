"""The whole of a clean: parse, refuse, strip, sweep, pack, write, read again, compare, report."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ACTIONS, DEFAULT, ERRORS, SENTENCES, Options, Profile, profile
from ..functions.sizes import derived, is_lossy, size_label, text_heavy_note
from ..sources.scratch import made, release, stored
from ..sources.tables import Tables, parse
from . import inspect as I
from . import objects as O
from .compress import pack, recompress, with_image_keys
from .strip import images_with_metadata, new_ids
from .write import parts, write


class Inspection:
    """What is told about files. Each table is made when it is first asked for, and then kept; ``scratch`` are those made so far.

    ``cleaned``: the files come out of a clean with the usual options, so another one would keep all of them.
    """

    def __init__(self, tables: Tables, cleaned: bool, scratch: list):
        self.tables, self.status, self.cleaned, self.scratch = tables, tables.status, cleaned, scratch
        self.images_coded: dict[Profile, DataFrame] = {}

    def made(self, name: str) -> DataFrame | None:
        """A table if it has been asked for."""
        return self.__dict__.get(name)

    def keep(self, make: Callable[[], DataFrame], name: str, compression: str | None = None) -> DataFrame:
        rows = make()
        held = len(made())
        out = stored(rows, name, compression)
        self.scratch += made()[held:]
        return out

    @cached_property
    def objects(self) -> DataFrame:
        return O.with_keys(self.keep(lambda: O.objects(self.tables.nodes), "object_rows"))

    @cached_property
    def facts(self) -> DataFrame:
        return self.keep(lambda: I.flags(self.tables.nodes, self.objects), "facts")

    @cached_property
    def signed(self) -> DataFrame:
        """doc_ids of signed files: a table so small that it need not be shuffled against others."""
        return self.keep(lambda: self.facts.where("signed").select("doc_id"), "signed")

    @cached_property
    def scrubbed(self) -> DataFrame:
        return self.keep(lambda: images_with_metadata(self.objects, self.tables.payloads), "scrubbed")

    @cached_property
    def kept(self) -> DataFrame:
        return self.tables.nodes if self.cleaned else self.keep(lambda: I.kept_after_clean(self.tables.nodes, self.objects), "kept")

    @cached_property
    def kept_objects(self) -> DataFrame:
        return self.objects if self.cleaned else O.with_keys(self.keep(lambda: O.objects(self.kept), "kept_objects"))

    @cached_property
    def kept_facts(self) -> DataFrame:
        return self.facts if self.cleaned else self.keep(lambda: I.flags(self.kept, self.kept_objects), "kept_facts")

    @cached_property
    def residuals(self) -> DataFrame:
        return I.residuals(self.kept_facts, self.signed)

    @cached_property
    def images(self) -> DataFrame:
        counts = lambda: I.image_counts(self.kept, self.kept_objects)
        return counts() if self.cleaned else self.keep(counts, "image_counts")

    @cached_property
    def findings(self) -> DataFrame:
        return self.keep(lambda: I.findings(self.tables.nodes, self.facts, self.scrubbed), "findings")

    @cached_property
    def inventory(self) -> DataFrame:
        return I.inventory(self.objects, self.tables.docs)

    @cached_property
    def parts(self) -> DataFrame:
        """What a clean with the usual options writes of each object, at any level but for the images that it encodes again."""
        return self.keep(lambda: parts(self.kept.join(self.signed, "doc_id", "left_anti")), "parts")

    @cached_property
    def packed(self) -> DataFrame:
        return self.keep(lambda: pack(self.tables.payloads), "packed", "zstd")

    def coded(self, level: int) -> DataFrame:
        """The images that a clean with the usual options encodes again at ``level`` (:func:`compress.recompress`)."""
        if profile(level) not in self.images_coded:
            nodes = self.kept.join(self.signed, "doc_id", "left_anti")
            images = images_to_code(self, self.scrubbed)
            self.images_coded[profile(level)] = self.keep(lambda: recompress(nodes, self.objects, images, I.mask_targets(nodes), profile(level)), "recompressed")
        return self.images_coded[profile(level)]


def inspect(files: DataFrame, cleaned: bool = False) -> Inspection:
    """Everything that is told about ``files`` (doc_id, length, content), or of files listed by :func:`ranges.list_files`, of which ranges are read only."""
    held = len(made())
    tables = parse(files)
    status = stored(I.with_pages(tables), "page_status")
    # few, so no other rows need be shuffled to leave them out
    lost = stored(status.where(F.col("reason").isin(*I.LOST_PAGES)).select("doc_id"), "lost_pages")
    nodes, docs = (t.join(lost, "doc_id", "left_anti") for t in (tables.nodes, tables.docs))
    return Inspection(Tables(status, docs, tables.xref, nodes, tables.payloads, tables.taken), cleaned, made()[held:])


def inspection_rows(files: DataFrame, seen: Inspection) -> DataFrame:
    """The whole inspection of each file that can be read, one row a file; an encrypted file has a row that says so and nothing else.

    doc_id, pages, the flags, the eight standard Info texts, counts, sizes, and ``findings`` and ``residuals`` as arrays in the order of display.
    """
    info = I.info_entries(seen.tables.nodes).where(F.col("key").isin(*(k for k, _ in I.INFO_LABELS)))
    names = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creation_date", "ModDate": "mod_date"}
    texts = info.groupBy("doc_id").agg(*(F.max(F.when(F.col("key") == k, F.col("text"))).alias(n) for k, n in names.items()))
    rows = lambda df, order, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, "label", "value"))).alias(name))
    jpegs = seen.scrubbed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("jpegs_with_metadata"))
    out = seen.status.where("error_code is null").select("doc_id", "pages").join(seen.facts, "doc_id")
    residuals = seen.residuals.withColumn("category", F.lit(I.STAYS))
    for part in (texts, jpegs, seen.images.selectExpr("doc_id", "images", "eligible as recompressible_images"), seen.inventory, rows(seen.findings, ["ord", "category"], "findings"), rows(residuals, ["category"], "residuals")):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0, ["jpegs_with_metadata", "images", "recompressible_images"])
    # a signed file's fields are not told
    out = out.withColumn("empty_signature_fields", F.expr("case when signed then 0 else empty_signature_fields end"))
    stub = seen.status.where("error_code = 'encrypted'").select("doc_id").join(files.selectExpr("doc_id", "length as file_bytes"), "doc_id")
    values = {"doc_id": F.col("doc_id"), "file_bytes": F.col("file_bytes"), "encrypted": F.lit(True)}
    values["findings"] = F.array(F.struct(F.lit(I.FLAGS - 1).alias("ord"), F.lit("Security").alias("category"), F.lit("Encryption").alias("label"), F.lit("Password-protected").alias("value")))
    blank = {"boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0), "string": F.lit(None)}
    stub = stub.select(*(values.get(f.name, blank.get(f.dataType.simpleString(), F.lit(None))).cast(f.dataType).alias(f.name) for f in out.schema))
    return out.unionByName(stub)


@dataclass
class Cleaned:
    """``files`` written (doc_id, length, content), ``status`` of all inputs, what was ``packed`` and ``recompressed`` (doc_id, obj), and both inspections.

    ``release`` deletes the scratch tables behind it, once its results have been used; those of an inspection that was given stay (``shared``).
    """

    files: DataFrame
    status: DataFrame
    packed: DataFrame
    recompressed: DataFrame
    before: Inspection
    after: Inspection
    scratch: list
    shared: bool

    def release(self) -> None:
        before = self.before.scratch
        release([t for t in self.scratch + self.after.scratch if t not in before] + ([] if self.shared else before))


def sanitize(files: DataFrame, options: Options = DEFAULT, level: int = 0, before: Inspection | None = None) -> Cleaned:
    """Clean ``files``. Give ``before``, their inspection, to clean them at several levels: parsing, stripping and the sweep are done once."""
    held, shared = len(made()), before is not None
    before = before or inspect(files)
    none = before.tables.docs.where("false").select("doc_id")
    refused = before.signed if options.fail_if_signed else none
    if options == DEFAULT:
        nodes, base = before.kept.join(refused, "doc_id", "left_anti"), before.parts
    else:
        nodes = before.tables.nodes if options.rewrite_only else stored(I.kept_after_clean(before.tables.nodes, before.objects, options), "kept")
        nodes = nodes.join(refused, "doc_id", "left_anti")
        base = stored(parts(nodes), "parts")
    payloads = before.tables.payloads.join(refused, "doc_id", "left_anti")
    streams = nodes.where("node_id = 0 and kind = 'stream'").select("doc_id", "obj")
    made_of, bytes_of = [base], [payloads.select("doc_id", "obj", "payload")]
    packed = recompressed = payloads.where("false").select("doc_id", "obj")
    if profile(level).pack:
        small = before.packed.join(refused, "doc_id", "left_anti")
        bytes_of = [payloads.where("not role <=> 'pack'").select("doc_id", "obj", "payload"), small]
        packed = small.where("shrunk").select("doc_id", "obj").join(streams, ["doc_id", "obj"], "left_semi")
    if options.images:
        bytes_of.append(before.scrubbed)
    if profile(level).edge:
        if options == DEFAULT:
            coded = before.coded(level)
        else:
            images = images_to_code(before, before.scrubbed if options.images else before.scrubbed.where("false"))
            coded = stored(recompress(nodes, before.objects, images, I.mask_targets(nodes), profile(level)), "recompressed")
        bytes_of.append(coded.select("doc_id", "obj", "payload"))
        # a table of its own, small enough to find their values without a shuffle of all
        recompressed = stored(coded.select("doc_id", "obj", "width", "height", "gray"), "recompressed_keys")
        own = nodes.join(recompressed.select("doc_id", "obj"), ["doc_id", "obj"], "left_semi")
        made_of.append(stored(parts(with_image_keys(own, recompressed)), "image_parts"))
    if options.new_file_id:
        made_of.append(stored(parts(new_ids(nodes.where("obj = -1"))), "trailers"))
    out = stored(write(made_of, bytes_of, before.tables.docs), "cleaned", "zstd")
    after = inspect(out, cleaned=options == DEFAULT)
    pages = after.status.selectExpr("doc_id", "pages as pages_after", "error_code as error_after")
    checked = before.status.join(refused.withColumn("refused", F.lit(True)), "doc_id", "left").join(pages, "doc_id", "left")
    lost = "error_code is null and refused is null and (error_after is not null or not (pages <=> pages_after))"
    status = checked.selectExpr("doc_id", f"case when refused then 'signed' when {lost} then 'corrupt' else error_code end as error_code", f"case when {lost} then 'pages changed' else reason end as reason", "pages")
    status = stored(status, "clean_status")
    good = status.where("error_code is null").select("doc_id")
    return Cleaned(out.join(good, "doc_id", "left_semi"), status, packed, recompressed.select("doc_id", "obj"), before, after, made()[held:], shared)


def images_to_code(seen: Inspection, scrubbed: DataFrame) -> DataFrame:
    """(doc_id, obj, payload) of images that can be encoded again, without their metadata where it is ``scrubbed``."""
    images = seen.objects.where(O.eligible()).select("doc_id", "obj")
    return replaced(seen.tables.payloads.where("role = 'dct'").join(images, ["doc_id", "obj"], "left_semi"), scrubbed)


def replaced(payloads: DataFrame, changed: DataFrame) -> DataFrame:
    """``payloads`` with the bytes of ``changed`` where there are any."""
    return payloads.join(changed.withColumnRenamed("payload", "_new"), ["doc_id", "obj"], "left").select("doc_id", "obj", F.coalesce("_new", "payload").alias("payload"))


def removed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings of ``before`` that are not found again, by category and label."""
    return before.join(after, ["doc_id", "category", "label"], "left_anti")


def report(done: Cleaned, level: int = 0) -> DataFrame:
    """One row a cleaned document: what was removed, what is left behind, what stays, sizes, and a sentence."""
    good = done.files.selectExpr("doc_id", "length as bytes_after")
    before = done.before.findings.where("category <> 'Security'").join(good, "doc_id", "left_semi")
    after = done.after.findings.where("category <> 'Security'").join(good, "doc_id", "left_semi")
    item = F.struct("ord", "category", "label", "value")
    listed = lambda df, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias(name))
    gone = listed(removed(before.where(F.col("label") != I.FILE_ID), after), "removed")
    left = listed(after.where(F.col("label") != I.FILE_ID), "left_behind")
    stays = done.after.residuals.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("label", "value"))).alias("still_present"))
    had_id = done.before.facts.selectExpr("doc_id", "has_id as replaced_file_id")
    packed = done.packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("streams_packed"))
    coded = done.recompressed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("images_recompressed"))
    sizes = done.before.tables.docs.selectExpr("doc_id", "file_bytes as bytes_before")
    out = good.join(sizes, "doc_id").join(had_id, "doc_id")
    for part in (gone, left, stays, packed, coded, done.before.images.selectExpr("doc_id", "images as image_count")):
        out = out.join(part, "doc_id", "left")
    out = out.fillna(0, ["streams_packed", "image_count", "images_recompressed"]).withColumn("level", F.lit(level))
    out = out.withColumn("changes", F.expr("coalesce(size(removed), 0) + cast(replaced_file_id as int)"))
    return out.withColumn("message", message(level))


def told(sentence: str, **values):
    """One of ``SENTENCES`` with its braces filled in by columns; null where one of them is."""
    parts = re.split(r"\{(\w+)\}", SENTENCES[sentence])
    return F.concat(*(values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def plural(n):
    return F.when(n == 1, "").otherwise("s")


def message(level: int):
    """The sentence on what was done."""
    n, labels = F.col("changes"), lambda c: F.array_join(F.transform(c, lambda e: e["label"]), ", ")
    left = F.size("left_behind")
    parts = [F.when(n == 0, told("nothing removed")).otherwise(told("removed", n=n, s=plural(n)))]
    parts.append(F.when(left == 1, told("one left", n=left, labels=labels("left_behind"))).when(left > 1, told("left", n=left, labels=labels("left_behind"))))
    if level > 0:
        p, r, images = F.col("streams_packed"), F.col("images_recompressed"), F.col("image_count")
        did = F.concat_ws(" and ", F.when(r > 0, told("re-encoded", n=r, all=images, s=plural(images))), F.when(p > 0, told("packed", n=p, s=plural(p))))
        parts.append(F.when((p == 0) & (r == 0), told("not compressed")).otherwise(told("compressed", what=did)))
        smaller = told("smaller", before=size_label("bytes_before"), after=size_label("bytes_after"))
        parts.append(F.when(F.col("bytes_after") < F.col("bytes_before"), smaller).otherwise(told("not smaller")))
    parts.append(F.when(F.col("still_present").isNotNull(), told("stays", labels=labels("still_present"))))
    return F.concat_ws(" ", *parts, told("original"))


def summary(done: Inspection) -> DataFrame:
    """(doc_id, summary_line, residual_line): one line each for the list of files."""
    removable = done.findings.where("category <> 'Security'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    stays = done.residuals.groupBy("doc_id").agg(F.concat(F.lit("Stays in the file: "), F.array_join(F.sort_array(F.collect_list("label")), ", "), F.lit(".")).alias("residual_line"))
    out = done.status.where("error_code is null").join(done.facts.select("doc_id", "signed"), "doc_id").join(removable, "doc_id", "left").fillna(0, ["n"]).join(stays, "doc_id", "left")
    line = "concat(pages, ' page', case when pages = 1 then '' else 's' end, case when signed then ' · signed' when n = 0 then ' · no removable metadata found' else concat(' · ', n, ' metadata item', case when n = 1 then '' else 's' end, ' to remove') end) as summary_line"
    return out.selectExpr("doc_id", line, "residual_line")


def scope_note(level, images, eligible):
    """For the lossy levels: how much of a file they can act on; null for others."""
    note = F.when(images == 0, told("no images")).when(eligible == 0, told("no eligible images", all=images, s=plural(images)))
    return F.when(is_lossy(level), note.otherwise(told("eligible images", n=eligible, all=images, s=plural(images))))


def action_title(level, removable):
    """What saving will do; ``level`` is clamped."""
    titles = [F.when(removable > 0, some).otherwise(none) for some, none in ACTIONS]
    return F.when(level <= 0, titles[0]).when(level == 1, titles[1]).otherwise(titles[2])


def review(done: Inspection) -> DataFrame:
    """(doc_id, level, action, scope_note, text_note): what the review says of each level."""
    removable = done.findings.where("category <> 'Security'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    out = done.status.where("error_code is null").select("doc_id").join(removable, "doc_id", "left").join(done.images, "doc_id", "left")
    out = out.join(derived(done.inventory).select("doc_id", "text_heavy"), "doc_id").fillna(0, ["n", "images", "eligible"])
    out = out.select("*", F.explode(F.array(*(F.lit(i) for i in range(5)))).alias("level"))
    level = F.col("level")
    return out.select("doc_id", "level", action_title(level, F.col("n")).alias("action"), scope_note(level, F.col("images"), F.col("eligible")).alias("scope_note"), text_heavy_note(level, F.col("text_heavy")).alias("text_note"))


def outcomes(status: DataFrame) -> DataFrame:
    """(outcome, n): how many files ended in which way, commonest first."""
    counts = status.groupBy(F.coalesce("error_code", F.lit("cleaned")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "outcome")


def error_text(code) -> object:
    return F.create_map(*(F.lit(x) for pair in ERRORS.items() for x in pair))[code]
