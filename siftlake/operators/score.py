"""Scores of candidates: confidence from signals, multipliers of context and calibration, floors, and penalties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions import text as T

#: The weight of each signal, of entropy by tier, and the multiplier of each context.
SIGNALS = {"has_literal_prefix": 0.35, "has_context_anchor": 0.20, "keyword_nearby": 0.10, "sensitive_file": 0.10, "has_companion": 0.05}
ENTROPY_TIERS = ((4.5, 0.20), (3.5, 0.12), (3.0, 0.05))
CONTEXTS = {"assignment": 1.0, "string": 0.9, "unknown": 0.8, "comment": 0.4, "documentation": 0.3, "test": 0.3, "encrypted": 0.05}
#: What marks a path as sensitive, anywhere in it and in any case.
SENSITIVE = (
    ".env", ".env.local", ".env.production", ".env.staging", "credentials", "secrets", "apikeys", "api_keys", ".npmrc", ".pypirc", ".netrc", ".pgpass", "terraform.tfvars", "variables.tf", "docker-compose",
    "application.yml", "application.properties", "config.json", "config.yaml", "config.toml", ".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".cer", ".crt", ".github/workflows", "gitlab-ci.yml", "Jenkinsfile",
    "buildspec.yml", "serverless.yml", "sam-template", "helm/values", "chart/values",
)
EXAMPLE_PARTS = ("example", "examples", "fixture", "fixtures", "sample", "samples", "testdata", "mock", "mocks")
#: The words of placeholders.
PLACEHOLDERS = ("example", "dummy", "fake", "mock", "sample", "placeholder", "changeme")
#: Each reason of evidence and its tier.
EVIDENCE = (
    ("unattributed", "review"), ("unsupported-context", "review"), ("required-evidence-missing", "review"), ("weak-anchor", "review"), ("generic-detector", "review"), ("generic-assignment", "review"), ("entropy-only", "review"),
    ("test-fixture", "review"), ("documentation", "review"), ("rule-definition", "review"), ("identifier", "review"), ("option-declaration", "review"), ("generated-material", "review"), ("source-role-mismatch", "review"),
    ("vendor-pattern", "likely"), ("structural-grammar", "confirmed"), ("required-companion", "confirmed"), ("checksum-valid", "confirmed"), ("live-verification", "confirmed"),
)


def base_confidence(entropy: Column, length: Column, **signals: Column) -> Column:
    """Sum of the weights of the signals that hold and of the entropy's tier; six tenths of it for long values of low entropy; at most 1."""
    tier = reduce(lambda found, t: found.when(entropy >= t[0], t[1]), ENTROPY_TIERS[1:], F.when(entropy >= ENTROPY_TIERS[0][0], ENTROPY_TIERS[0][1])).otherwise(0.0)
    total = reduce(lambda a, b: a + b, (F.when(held, SIGNALS[name]).otherwise(0.0) for name, held in signals.items()), tier)
    return F.least(F.lit(1.0), total * F.when((entropy < 2.0) & (length > 10), 0.60).otherwise(1.0))


def context_multiplier(context: Column) -> Column:
    first, *rest = CONTEXTS.items()
    found = F.when(context == first[0], first[1])
    for name, value in rest:
        found = found.when(context == name, value)
    return found.otherwise(CONTEXTS["unknown"])


def hard_suppressed(context: Column, score: Column) -> Column:
    """Too weak for where it stands."""
    return (context.isin("documentation", "test", "comment") & (score < 0.5)) | ((context == "encrypted") & (score < 0.8))


def named_floor(score: Column, named: Column, floor: float = 0.55) -> Column:
    return F.when(named, F.greatest(score, F.lit(floor))).otherwise(score)


def is_placeholder(value: Column) -> Column:
    """Holds a word that marks samples, is mostly x, or ends as an example."""
    low = F.lower(value)
    words = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in PLACEHOLDERS))
    crossed = (F.length(value) >= 16) & (4 * (F.length(low) - F.length(F.replace(low, F.lit("x"), F.lit("")))) > 3 * F.length(value))
    return words | crossed | F.endswith(value, F.lit("EXAMPLE"))


def penalised(score: Column, value: Column) -> Column:
    """Placeholders count a twentieth, values of few distinct characters or one long run a tenth."""
    score = score * F.when(is_placeholder(value), 0.05).otherwise(1.0)
    score = score * F.when(T.char_diversity(value) < 0.1, 0.1).otherwise(1.0)
    return score * F.when((F.length(value) >= 10) & (T.longest_run(value) / F.length(value) > 0.8), 0.1).otherwise(1.0)


def prefix_floor(score: Column, value: Column, prefixes: tuple[str, ...], floor: float = 0.8) -> Column:
    """A known prefix lifts the score, unless what follows is a placeholder or one long run."""
    known = reduce(lambda a, b: a | b, (F.startswith(value, F.lit(p)) for p in prefixes))
    fair = ~is_placeholder(value) & (T.longest_run(value) / F.length(value) <= 0.8)
    return F.when(known & fair, F.greatest(score, F.lit(floor))).otherwise(score)


def sensitive_path(path: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(path), F.lit(m.lower())) for m in SENSITIVE))


def fixture_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, EXAMPLE_PARTS)))


def calibrated(rows: DataFrame, counters: DataFrame) -> DataFrame:
    """``confidence`` times alpha / (alpha + beta) for detectors that were observed; counters: detector_id, alpha, beta over the prior (1, 1)."""
    factor = F.when(F.col("alpha") + F.col("beta") > 2, F.col("alpha") / (F.col("alpha") + F.col("beta"))).otherwise(1.0)
    return rows.join(counters, "detector_id", "left").withColumn("confidence", F.col("confidence") * F.coalesce(factor, F.lit(1.0))).drop("alpha", "beta")


def evidence_reason(detector_id: Column, channel: Column, context: Column, path: Column, checksum: Column, companions: Column, live: Column) -> Column:
    """The strongest reason that speaks for or against a finding, in this order: what was verified, its checksum, where it stands, how it was found."""
    return (
        F.when(live, "live-verification")
        .when(checksum == "valid", "checksum-valid")
        .when(fixture_path(path) | (context == "test"), "test-fixture")
        .when(context == "documentation", "documentation")
        .when(F.size(companions) > 0, "required-companion")
        .when(channel == "entropy", "entropy-only")
        .when(channel == "assignment", "generic-assignment")
        .when(detector_id.isin("private-key-block", "json-web-token", "connection-string"), "structural-grammar")
        .otherwise("vendor-pattern")
    )


def evidence_tier(reason: Column) -> Column:
    """The tier of a reason; null for none of them."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in EVIDENCE for x in pair)), reason)


def checksum_verdict(value: Column, validators: Column) -> Column:
    """``valid``, ``invalid`` or ``none``, by a detector's validators (an array of names): none says anything of a value that hasn't their form."""
    from siftlake.functions import codecs as C

    prefixed = value.rlike("^[A-Za-z]{2,5}_[0-9A-Za-z]{36}$")
    start = F.instr(value, "_")
    body = F.substring(value, start + 1, F.length(value) - start - 6)
    crc = F.when(F.array_contains(validators, "crc32-base62") & prefixed, F.right(value, F.lit(6)) == C.base62(F.crc32(F.encode(body, "UTF-8")), 6))
    tail = F.regexp_extract(value, "^[A-Za-z]+-([A-Za-z0-9_-]{16,})$", 1)
    payload = F.when(F.array_contains(validators, "base64-payload") & (tail != ""), F.try_to_binary(F.translate(F.rpad(tail, (F.ceil(F.length(tail) / 4) * 4).cast("int"), F.lit("=")), "-_", "+/"), F.lit("base64")).isNotNull())
    good = F.coalesce(crc, payload)
    return F.when(good, "valid").when(~good, "invalid").otherwise("none")


def by_checksum(rows: DataFrame, floor: float = 0.9) -> DataFrame:
    """Rows with ``checksum`` and confidence: invalid ones go, valid ones have the floor at least, others stay as they are."""
    return rows.where("checksum <> 'invalid'").withColumn("confidence", F.when(F.col("checksum") == "valid", F.greatest("confidence", F.lit(floor))).otherwise(F.col("confidence")))


def adjusted_severity(rank: Column, history: Column, client_safe: Column, outcome: Column) -> Column:
    """A severity one step lower in history, one step lower if the credential is dead or revoked, and ``client-safe`` (1) if it may be public."""
    steps = F.when(history, 1).otherwise(0) + F.when(outcome.isin("dead", "revoked"), 1).otherwise(0)
    return F.when(client_safe, F.lit(1)).otherwise(lowered(rank, steps))


def lowered(rank: Column, steps: Column | int = 1) -> Column:
    """A severity some steps lower, the lowest at least."""
    return F.greatest(F.lit(0), rank - steps)


def bigram_model(words: DataFrame) -> DataFrame:
    """Log probability of each pair of letters after its first, over all words (one word for each row of ``word``); with one more of each pair that occurs."""
    pairs = words.select(F.explode(F.regexp_extract_all(F.lower("word"), F.lit("[a-z]+"), F.lit(0))).alias("w")).where("length(w) > 1").groupBy("w").agg(F.count("*").alias("n"))
    pairs = pairs.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.substring(F.col("w"), k, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("pair").agg((F.sum("n") + 1).alias("n"))
    totals = counts.groupBy(F.left("pair", F.lit(1)).alias("first")).agg(F.sum("n").alias("total"))
    return counts.join(totals, F.left(counts.pair, F.lit(1)) == totals["first"]).select("pair", F.log(F.col("n") / F.col("total")).alias("log_p"))


def generic_confidence(entropy: Column, length: Column) -> Column:
    """Confidence of an assigned value: a base, lifted by entropy and length, 0.95 at most."""
    lift = F.when(entropy >= 4.5, 0.2).when(entropy >= 3.5, 0.1).otherwise(0.0) + F.when(length >= 32, 0.15).when(length >= 20, 0.05).otherwise(0.0)
    return F.least(F.lit(0.95), 0.5 + lift)


def fallback_confidence(entropy: Column, keyword: Column) -> Column:
    """Confidence of a token that only its entropy tells, by tier, and a little more on a keyword's line; 0.9 at most."""
    return F.least(F.lit(0.9), F.when(entropy >= 5.8, 0.75).when(entropy >= 4.5, 0.65).otherwise(0.55) + F.when(keyword, 0.10).otherwise(0.0))


def randomness(words: DataFrame, model: DataFrame) -> DataFrame:
    """Mean log probability of each word's letter pairs; low means random."""
    pairs = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring(F.col("word"), k, F.lit(2)))).alias("pair"))
    return pairs.join(model, "pair").groupBy("word").agg(F.avg("log_p").alias("mean_log_p"))
