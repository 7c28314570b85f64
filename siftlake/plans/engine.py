"""The whole scan as one plan: detectors, scores, suppression, decode-through, winners, and filters of known findings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import text as T
from siftlake.operators import context, decode, extract, mixture, resolve, score, shapes, suppress, windows
from siftlake.operators.windows import once
from siftlake.sources.tables import read, seeded_chunks

from .detectors import BUILT_IN, ENTROPY_TOKEN, Detector, Pattern
from .registry import query
from .scans import DIVERSITY, ENTROPY, PLACEHOLDER, RANKS, REDACTED, RUN, SCAN, SERVICES, STAGE_SQL, quoted

#: Detectors without a format of their own: their values pass the whole ladder, the others' only what marks examples.
GENERIC = ("generic-secret",)


@dataclass(frozen=True)
class Policy:
    """``fast``: no decoding; ``deep``: decoding in two layers; ``precision``: only what is nearly certain."""

    depth: int = 0
    least_confidence: float = 0.4

    @classmethod
    def named(cls, name: str) -> Policy:
        presets = {"fast": cls(0), "default": cls(1), "deep": cls(2), "precision": cls(1, 0.85)}
        if name not in presets:
            raise ValueError(f"no preset {name}; there are {', '.join(presets)}")
        return presets[name]


@dataclass(frozen=True)
class Controls:
    """What a caller says about findings, all of it optional.

    ``rules``: tables of conditions, see ``suppress.rules``; ``allow``: globs of paths; ``fixtures`` and ``fixture_parts``: known test values, and parts of such; ``calibration``: detector_id,
    alpha, beta; ``verified``: credential_hash, outcome; ``baseline`` and ``triage``: detector_id, credential_hash of findings that are known, and that were judged false. Each drop is a stage:
    ``rule``, ``allowed_path``, ``fixture_value``, ``in_baseline``, ``triaged``. ``model``: a fitted mixture, whose probability is half of the confidence of candidates that no detector names.
    """

    rules: tuple[dict, ...] = ()
    allow: tuple[str, ...] = ()
    fixtures: tuple[str, ...] = ()
    fixture_parts: tuple[str, ...] = ()
    calibration: DataFrame | None = None
    verified: DataFrame | None = None
    baseline: DataFrame | None = None
    triage: DataFrame | None = None
    model: mixture.Mixture | None = None


#: A path in a commit of history, and not in what is there now.
HISTORY = "^[0-9a-f]{40}:"


def _by_detector(detectors: tuple[Detector, ...], what) -> Column:
    return F.element_at(F.create_map(*(x for d in detectors for x in (F.lit(d.id), F.lit(what(d))))), F.col("detector_id"))


def scored(matches: DataFrame, detectors: tuple[Detector, ...]) -> DataFrame:
    """Adds entropy, confidence and stage (why a candidate is dropped; null: it isn't)."""
    v, named = F.col("value"), ~F.col("detector_id").isin(*GENERIC)
    prefix = _by_detector(detectors, lambda d: d.prefix)
    rows = matches.withColumn("entropy", T.shannon_entropy(v)).withColumn("_known", (prefix != "") & F.startswith(v, prefix))
    base = score.base_confidence(F.col("entropy"), F.length(v), has_literal_prefix=F.col("_known"), has_context_anchor=named, keyword_nearby=F.lit(True), sensitive_file=score.sensitive_path(F.col("path")))
    confidence = score.penalised(score.named_floor(base, named), v)
    confidence = F.when(F.col("_known") & ~score.is_placeholder(v), F.greatest(confidence, F.lit(0.8))).otherwise(confidence)
    confidence = confidence * F.when(score.fixture_path(F.col("path")), 0.5).otherwise(1.0)
    example = F.when(score.is_placeholder(v), "placeholder")
    return rows.withColumn("confidence", T.safe_score(confidence)).withColumn("stage", F.when(named, example).otherwise(suppress.stage(v))).drop("_known")


def scan(chunks: DataFrame, detectors: tuple[Detector, ...] = BUILT_IN, policy: Policy | str = "default", baseline: DataFrame | None = None, rules: list[dict] | None = None, allow: list[str] | None = None) -> DataFrame:
    """Findings of chunks: doc_id, path, detector_id, service, severity_rank, redacted, credential_hash, line_no, byte_offset, confidence and decoded.

    One finding for each credential and path. Findings in decoded text stand at the place of no line; those at a real place win over them.
    """
    policy = Policy.named(policy) if isinstance(policy, str) else policy
    found = extract.scan(chunks, detectors).drop("pattern_no").withColumn("decoded", F.lit(False))
    if policy.depth:
        inner = decode.decode_through(chunks, policy.depth, keys=("doc_id", "path"))
        inner = inner.select("doc_id", "path", "text", F.lit(0).cast("long").alias("base_line"), F.lit(0).cast("long").alias("base_offset"))
        deep = extract.scan(inner, detectors).select("doc_id", "path", "detector_id", "value", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("long").alias("byte_offset"), F.lit(True).alias("decoded"))
        found = found.unionByName(deep)
    rows = extract.with_detector(scored(found, detectors), detectors).where((F.col("confidence") >= policy.least_confidence) & F.col("stage").isNull())
    rows = rows.select("doc_id", "path", "detector_id", "service", "severity_rank", T.redact(F.col("value")).alias("redacted"), F.sha2("value", 256).alias("credential_hash"), "line_no", "byte_offset", F.round("confidence", 6).alias("confidence"), "decoded")
    order = F.struct(~F.col("decoded"), ~F.col("detector_id").isin(*GENERIC), F.col("confidence"), F.col("severity_rank"), F.col("detector_id"), -F.coalesce("byte_offset", F.lit(0)))
    best = rows.groupBy("doc_id", "path", "credential_hash").agg(F.max_by(F.struct("detector_id", "service", "severity_rank", "redacted", "line_no", "byte_offset", "confidence", "decoded"), order).alias("f"))
    rows = best.select("doc_id", "path", "credential_hash", "f.*")
    if rules:
        rows = rows.where(~suppress.rules(rules))
    if allow:
        rows = rows.where(~suppress.allowed(F.col("path"), allow))
    return resolve.not_in_baseline(rows, baseline) if baseline is not None else rows


#: Producers of the scan beside the patterns and ENTROPY_TOKEN: values assigned to a credential-like name; one character over the longest marks an overflow.
LONGEST = 128
ASSIGNMENT = Detector(
    "generic-assignment", "Generic Assignment", "generic", "medium", ("token", "secret", "passw", "pwd", "passphrase", "credential", "key", "auth"),
    (Pattern(r"""(?i)(?=[tspca])(?:token|secret|passw(?:or)?d|pwd|passphrase|credential|api_?key|access_?key|private_?key|auth)[A-Za-z0-9_-]{0,20}["']? ?(?::=|=>|=|:) ?["']?([A-Za-z0-9_+/.=!@#$%^&*-]{8,129})""", 1),),
)
#: Characters of a text that are searched at once.
WINDOW = 1 << 15
CHANNELS = ("pattern", "assignment", "entropy", "multiline", "fragment", "decoded")
AFTER_NUMBER = "[0-9] ?[:=]"
NUMBERED = r"""([A-Za-z_]{2,40}?)_?[0-9]{1,3} ?[:=] ?["']?([A-Za-z0-9_+/=-]{6,128})"""


def candidates(chunks: DataFrame, detectors: tuple[Detector, ...] = BUILT_IN, policy: Policy | str = "default", window: int = WINDOW) -> DataFrame:
    """What the producers find, each tagged with its ``channel``: doc_id, path, detector_id, pattern_no, value, line_no, byte_offset, line, above,
    in_hex, context, companions and around (of decoded text: what stood before the blob on its line; else empty).

    Patterns over the text, over values written on several lines, over joined fragments, and over decoded text; assignments; and tokens of high entropy. Texts of more
    than ``window`` characters are searched and decoded block by block.
    """
    policy = Policy.named(policy) if isinstance(policy, str) else policy
    named = tuple(d for d in detectors if d.id not in GENERIC)
    many = sum(len(d.patterns) for d in named) > 64
    columns = ("doc_id", "path", "detector_id", "pattern_no", "value", "line_no", "byte_offset", "line", "above", "in_hex", "context", "companions", "around", "channel")

    def over(rows: DataFrame, channel: str, keep: tuple[str, ...] = ()) -> DataFrame:
        return extract.scan(rows, named, anchors=many, context=True, keep=("around", *keep), window=window).withColumn("channel", F.lit(channel))

    # One pass over the text for patterns, assignments and tokens.
    found = extract.scan(chunks, (*named, ASSIGNMENT, ENTROPY_TOKEN), anchors=many, context=True, window=window).withColumn("around", F.lit(""))
    found = found.withColumn("channel", F.when(F.col("detector_id") == ASSIGNMENT.id, "assignment").when(F.col("detector_id") == ENTROPY_TOKEN.id, "entropy").otherwise("pattern"))
    entropy, on_line = T.byte_entropy(F.col("value")), F.col("line").rlike("(?i)token|secret|password|key|bearer")
    strong = (on_line & (entropy >= 3.5)) | ((F.trim("line") == F.col("value")) & (entropy >= 4.5))
    found = found.where((F.col("channel") != "entropy") | strong).select(*columns)

    zero, none = F.lit(None).cast("long"), F.lit("").alias("around")
    joined = windows.continuations(chunks, "doc_id", "path", size=window).select("doc_id", "path", F.col("line").alias("text"), (F.col("line_no") - 1).alias("base_line"), zero.alias("base_offset"), none)
    found = found.unionByName(over(joined, "multiline").select(*columns))

    scope = F.concat_ws("\x1f", F.col("doc_id").cast("string"), "path")
    # A number before a mark is rare, and quickly looked for; only lines that have one are asked for a name.
    lines = extract.lines(chunks.where(F.col("text").rlike(AFTER_NUMBER)), "path").where(F.col("line").rlike(AFTER_NUMBER))
    pairs = lines.where(F.col("line").rlike(NUMBERED)).select(scope.alias("path"), F.regexp_extract("line", NUMBERED, 1).alias("prefix"), "line_no", F.regexp_extract("line", NUMBERED, 2).alias("value"))
    whole = windows.joined_fragments(pairs.withColumnRenamed("line_no", "line"))
    parts = F.split("path", "\x1f", 2)
    fragments = whole.select(F.get(parts, F.lit(0)).try_cast("long").alias("doc_id"), F.get(parts, F.lit(1)).alias("path"), F.col("joined").alias("text"), (F.least("line", "line_b") - 1).alias("base_line"), zero.alias("base_offset"), none)
    found = found.unionByName(over(fragments, "fragment").select(*columns))

    if policy.depth:
        prefixes = tuple(sorted({d.prefix for d in named if len(d.prefix) >= 3}))
        decoders = {k: v for k, v in ({d: decode.DECODERS[d] for d in decode.DEFAULT if d != "reverse"} | decode.for_prefixes(prefixes)).items()}
        inner = decode.splice_through(chunks, policy.depth, decoders).where(decode.screened(F.col("text"))).withColumnRenamed("parent", "around")
        deep = over(inner, "decoded", ("span",))
        inside = (F.col("at") < F.col("span.end")) & (F.col("at") + F.length("value") > F.col("span.start"))
        found = found.unionByName(deep.where(inside).select(*columns))
    return once(found)


def judged(found: DataFrame, detectors: tuple[Detector, ...] = BUILT_IN, policy: Policy | str = "default", controls: Controls = Controls()) -> DataFrame:
    """Candidates with checksum, entropy, confidence, severity, reason and tier of evidence, and ``stage``: why one is dropped; null: it isn't."""
    policy = Policy.named(policy) if isinstance(policy, str) else policy
    every = (*detectors, ASSIGNMENT, ENTROPY_TOKEN)
    named = ~F.col("channel").isin("assignment", "entropy")
    of = lambda what: _by_detector(every, what)
    v = F.col("value")
    rows = extract.with_required(extract.with_relations(found, detectors), detectors)
    rows = rows.withColumn("checksum", score.checksum_verdict(v, F.element_at(F.create_map(*(x for d in every for x in (F.lit(d.id), F.array(*map(F.lit, d.validators)).cast("array<string>")))), F.col("detector_id"))))
    prefix = of(lambda d: d.prefix)
    rows = rows.withColumn("entropy", T.byte_entropy(v)).withColumn("_known", (prefix != "") & F.startswith(v, prefix)).withColumn("_sample", score.is_placeholder(v))
    rows = rows.withColumn("credential_hash", F.sha2(v, 256))
    if controls.verified is not None:
        outcomes = controls.verified.groupBy("credential_hash").agg(F.max_by("outcome", F.col("outcome") == "live").alias("_outcome"))
        rows = rows.join(outcomes, "credential_hash", "left")
    else:
        rows = rows.withColumn("_outcome", F.lit(None).cast("string"))
    rows = once(rows)
    keyword = F.col("line").rlike("(?i)token|secret|password|key|bearer")
    base = score.base_confidence(F.col("entropy"), F.length(v), has_literal_prefix=F.col("_known"), has_context_anchor=named, keyword_nearby=F.lit(True), sensitive_file=score.sensitive_path(F.col("path")), has_companion=F.size("companions") > 0)
    by_channel = F.when(F.col("channel") == "assignment", score.generic_confidence(F.col("entropy"), F.length(v))).when(F.col("channel") == "entropy", score.fallback_confidence(F.col("entropy"), keyword)).otherwise(score.named_floor(base, named))
    confidence = score.penalised(by_channel, v) * score.context_multiplier(F.col("context"))
    confidence = F.when(F.col("_known") & ~F.col("_sample") & ~F.col("context").isin("encrypted", "test", "documentation", "comment"), F.greatest(confidence, F.lit(0.8))).otherwise(confidence)
    confidence = F.when(F.col("checksum") == "valid", F.greatest(confidence, F.lit(0.9))).otherwise(confidence) * F.when(score.fixture_path(F.col("path")), 0.5).otherwise(1.0)
    rows = once(rows.withColumn("confidence", T.safe_score(confidence)))
    if controls.model is not None:
        own = (F.col("confidence") + mixture.probability(controls.model, v, F.col("line"), F.col("path"))) / 2
        rows = once(rows.withColumn("confidence", F.when(named, F.col("confidence")).otherwise(F.round(own, 9))))
    if controls.calibration is not None:
        rows = once(score.calibrated(rows, controls.calibration))
    public = [(d.id, k) for d in detectors for k, p in enumerate(d.patterns) if p.client_safe]
    client_safe = reduce(or_, ((F.col("detector_id") == i) & (F.col("pattern_no") == k) for i, k in public), F.lit(False))
    severity = score.adjusted_severity(F.col("severity_rank"), F.col("path").rlike(HISTORY), client_safe, F.coalesce("_outcome", F.lit("")))
    rows = extract.with_detector(rows, every).withColumn("severity_rank", severity)
    known = {"in_baseline": controls.baseline, "triaged": controls.triage}
    for flag, table in known.items():
        if table is not None:
            rows = rows.join(table.select(*resolve.KEY).distinct().withColumn(f"_{flag}", F.lit(True)), resolve.KEY, "left")
    name = F.regexp_extract("line", r"""([A-Za-z0-9_.-]{2,64})["']?\s*(?::=|=>|=|:)""", 1)
    # A value of a key's own width or alphabet is judged by what it says, not by its shape.
    canonical = v.rlike("^[A-Za-z0-9+/]{40}$|^[A-Za-z0-9_-]{43}=?$") & v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    exact, least, most = of(lambda d: d.exact_length), of(lambda d: d.min_length), of(lambda d: d.max_length or LONGEST * 8)
    own_lists = F.lit(False)
    for d in detectors:
        if d.stopwords or d.allowed:
            own_lists = own_lists | ((F.col("detector_id") == d.id) & shapes.stopped(v, d.stopwords, d.allowed))
    floor = F.greatest(of(lambda d: float(d.min_confidence)), F.lit(policy.least_confidence))
    stage = F.coalesce(
        F.when((exact > 0) & (F.length(v) != exact), "detector_credential_shape_invalid"),
        F.when(F.length(v) < least, "below_detector_min_length"),
        F.when((F.length(v) > most) | ((F.col("channel") == "assignment") & (F.length(v) > LONGEST)), "value_too_long"),
        F.when(own_lists, "detector_list"),
        F.when(suppress.directed(F.col("line"), F.col("above"), F.col("detector_id")), "inline_directive"),
        F.when(suppress.rules(list(controls.rules)), "rule") if controls.rules else F.lit(None),
        F.when(suppress.allowed(F.col("path"), list(controls.allow)), "allowed_path") if controls.allow else F.lit(None),
        F.when(context.fixture_value(v, controls.fixtures, controls.fixture_parts), "fixture_value") if controls.fixtures or controls.fixture_parts else F.lit(None),
        *(F.when(F.col(f"_{flag}"), flag) for flag, table in known.items() if table is not None),
        F.when(F.col("checksum") == "invalid", "checksum_invalid"),
        F.when(F.col("_sample"), "placeholder"),
        F.when(F.col("channel") == "decoded", context.decoded_suppression(v, F.col("around"), named)),
        F.when(~named, F.coalesce(suppress.stage(v), F.when(F.col("in_hex") & T.is_hex(v), "hex_context"), F.when(shapes.hex_decoy(v, name), "hex_decoy"), shapes.example_ladder(v, canonical), F.when(context.decoded_benign(v), "decoded_benign"), F.when(shapes.base64_decoy(v), "base64_decoy"))),
        F.when(score.hard_suppressed(F.col("context"), F.col("confidence")), "hard_suppressed_context"),
        F.when(F.col("confidence") < floor, "below_min_confidence"),
    )
    reason = score.evidence_reason(F.col("detector_id"), F.col("channel"), F.col("context"), F.col("path"), F.col("checksum"), F.col("companions"), F.coalesce(F.col("_outcome") == "live", F.lit(False)))
    rows = once(rows.withColumn("stage", stage).withColumn("reason", reason).drop("_known", "_sample", "_outcome", "_in_baseline", "_triaged"))
    if policy.depth:
        # A value that a named detector reports as it stands is the credential there; what its characters say in some code, too, isn't another one.
        place = Window.partitionBy("doc_id", "path", "detector_id", "line_no", "byte_offset")
        plain = F.max((F.col("channel") == "pattern") & F.col("stage").isNull()).over(place)
        again = F.col("stage").isNull() & (F.col("channel") == "decoded") & F.col("byte_offset").isNotNull() & plain
        rows = rows.withColumn("stage", F.when(again, "decoded_of_finding").otherwise(F.col("stage")))
    return rows.withColumn("tier", score.evidence_tier(F.col("reason")))


def full_scan(chunks: DataFrame, detectors: tuple[Detector, ...] = BUILT_IN, policy: Policy | str = "default", window: int = WINDOW, controls: Controls = Controls()) -> DataFrame:
    """The scan with all producers: one finding for each credential and path, with what else was found of it.

    ``controls``: what the caller knows of findings: rules, paths, fixtures, calibration, verdicts, a baseline and triage.
    A named detector wins over an assignment, and that over entropy; then what has a place of its own, confidence, severity and id. ``others``: ids of the
    detectors that found the same value; ``locations``: its distinct other lines in order.
    """
    rows = judged(candidates(chunks, detectors, policy, window), detectors, policy, controls).where("stage IS NULL")
    rows = rows.withColumn("redacted", T.redact(F.col("value"))).withColumn("_rank", F.array_position(F.array(*map(F.lit, ("entropy", "assignment"))), F.col("channel")))
    order = F.struct(F.when(F.col("_rank") == 0, 3).otherwise(F.col("_rank")), ~F.col("channel").isin("decoded", "fragment", "multiline"), "confidence", "severity_rank", "detector_id", -F.coalesce("byte_offset", F.lit(0)))
    picked = F.struct("detector_id", "service", "severity_rank", "redacted", "line_no", "byte_offset", "channel", "context", F.round("confidence", 6).alias("confidence"), "reason", "tier", "companions")
    best = rows.groupBy("doc_id", "path", "credential_hash").agg(F.max_by(picked, order).alias("f"), F.array_sort(F.collect_set("detector_id")).alias("_ids"), F.array_sort(F.collect_set("line_no")).alias("_lines"))
    best = best.select("doc_id", "path", "credential_hash", "f.*", F.array_remove("_ids", F.col("f.detector_id")).alias("others"), F.array_remove("_lines", F.coalesce("f.line_no", F.lit(-1).cast("long"))).alias("locations"))
    return best.withColumn("companions", F.transform_values("companions", lambda _, x: T.redact(x)))


def explain(chunks: DataFrame, detectors: tuple[Detector, ...] = BUILT_IN, policy: Policy | str = "default", controls: Controls = Controls()) -> DataFrame:
    """Every candidate, redacted, with what was said of it: channel, context, checksum, confidence, reason and the stage that drops it (``reported``: none)."""
    rows = judged(candidates(chunks, detectors, policy), detectors, policy, controls)
    return rows.select("doc_id", "path", "detector_id", T.redact(F.col("value")).alias("redacted"), "line_no", "channel", "context", "checksum", F.round("confidence", 6).alias("confidence"), "reason", "tier", F.coalesce("stage", F.lit("reported")).alias("stage"))


KNOWN = "(" + " OR ".join(f"(detector_id = {quoted(d.id)} AND starts_with(value, {quoted(d.prefix)}))" for d in BUILT_IN if d.prefix) + ")"
SENSITIVE = "(" + " OR ".join(f"contains(lower(path), '{m.lower()}')" for m in score.SENSITIVE) + ")"
SCAN_FINDINGS = f"""{SCAN.rstrip()}, m AS (SELECT m.*, s.path, {ENTROPY.format(v='value')} AS e, {KNOWN} AS known, detector_id <> 'generic-secret' AS named, {PLACEHOLDER.format(v='value')} AS sample FROM matches m JOIN seeded s USING (doc_id)),
b AS (SELECT *, least(1.0::DOUBLE, (CASE WHEN e >= 4.5 THEN 0.2::DOUBLE WHEN e >= 3.5 THEN 0.12 WHEN e >= 3.0 THEN 0.05 ELSE 0 END + CASE WHEN known THEN 0.35 ELSE 0 END + CASE WHEN named THEN 0.2 ELSE 0 END + 0.1 + CASE WHEN {SENSITIVE} THEN 0.1 ELSE 0 END) * CASE WHEN e < 2 AND length(value) > 10 THEN 0.6 ELSE 1 END) AS base FROM m),
p AS (SELECT *, (CASE WHEN named THEN greatest(base, 0.55) ELSE base END) * CASE WHEN sample THEN 0.05 ELSE 1 END * CASE WHEN {DIVERSITY.format(v='value')} < 0.1 THEN 0.1 ELSE 1 END * CASE WHEN length(value) >= 10 AND {RUN.format(v='value')} / length(value) > 0.8 THEN 0.1 ELSE 1 END AS pen FROM b),
c AS (SELECT *, round((CASE WHEN known AND NOT sample THEN greatest(pen, 0.8) ELSE pen END)::DOUBLE, 6) AS confidence, CASE WHEN named THEN CASE WHEN sample THEN 'placeholder' END ELSE {STAGE_SQL} END AS stage FROM p),
r AS (SELECT *, sha256(value) AS credential_hash, row_number() OVER (PARTITION BY doc_id, path, sha256(value) ORDER BY named DESC, confidence DESC, ({RANKS}) DESC, detector_id DESC, byte_offset) AS rn FROM c WHERE stage IS NULL AND confidence >= 0.4)
SELECT doc_id, path, credential_hash, detector_id, {SERVICES} AS service, ({RANKS})::INT AS severity_rank, {REDACTED.format(v='value')} AS redacted, line_no, byte_offset, confidence, false AS decoded FROM r WHERE rn = 1"""


@query(SCAN_FINDINGS)
def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The whole scan under the fast preset."""
    return scan(seeded_chunks(read(spark, folder, "documents")), policy="fast")


def _encoded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text, and behind it a line that holds a token in base64 only."""
    token = F.concat(F.lit("x ghp_"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 36), F.lit(" y"))
    blob = F.translate(F.base64(F.encode(token, "UTF-8")), "\r\n", "")
    return read(spark, folder, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\nblob "), blob).alias("text"), F.lit(0).cast("long").alias("base_line"), F.lit(0).cast("long").alias("base_offset"))


@query("SELECT doc_id, sha256('ghp_' || sha256(doc_id::VARCHAR)[1:36]) AS credential_hash, 'github-classic-pat' AS detector_id, true AS decoded FROM documents")
def scan_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The whole scan with decoding, over texts whose tokens are in base64."""
    return scan(_encoded_chunks(spark, folder), policy="default").select("doc_id", "credential_hash", "detector_id", "decoded")
