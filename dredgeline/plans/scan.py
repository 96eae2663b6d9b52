"""Scan jobs: requests, documents and files, diffs, responses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredgeline.operators import detect, extract, filters, governance, identity, policy, textprep, tooling
from dredgeline.plans.plugins import Plugins
from dredgeline.session import spread
from dredgeline.sources import files


#: Findings of one request in detector order: field, decoded variant, rule, match.
ORDER = ("field_no", "variant", "rule_no", "match_no")


@dataclass
class ScanConfig:
    rules: Sequence[detect.Rule] = field(default_factory=lambda: [r for r in detect.community_rules() if r.detector != "injection"])
    default_action: str = "alert"
    overrides: dict[str, str] = field(default_factory=dict)
    allow_secrets: Sequence[str] = ()
    allow_pii: Sequence[str] = ()
    allow_paths: Sequence[str] = ()
    decode: bool = True
    decode_depth: int = 2
    budget: int | None = None  # characters of a request that are scanned, newest first; None: all
    max_decoded: int | None = None  # characters kept of a decoded text; None: all
    detect_rules: bool = True
    detect_proprietary: bool = True
    entropy_gate: bool = False
    distinct_texts: bool = False  # scan each distinct text once (many exact copies)
    stop_at_block: bool = False
    licensed: bool = False
    plugins: Plugins = field(default_factory=Plugins)


def _detect(texts: DataFrame, keys: Sequence[str], cfg: ScanConfig) -> DataFrame:
    """Findings of every enabled detector over (keys, field_no, path, text, source_filename)."""
    keep = [*keys, "field_no", "variant"]
    rules = detect.active_rules(cfg.rules, licensed=cfg.licensed, skip=cfg.plugins.skip_rules) if cfg.detect_rules else []
    if not rules and not cfg.detect_proprietary:
        raise ValueError("every detector is switched off")
    # Rules, file names and keywords are arms of one array: the prepared text is evaluated once.
    out = detect.scan(texts, rules, "text", "path", keep=keep, stop_at_block=cfg.stop_at_block and not cfg.entropy_gate,
                      proprietary="source_filename" if cfg.detect_proprietary else None)
    if cfg.entropy_gate:
        out = detect.entropy_gate(out, rules)
    out = cfg.plugins.run_detectors(texts, out)
    return cfg.plugins.run_allowlist(out, cfg.allow_secrets, cfg.allow_pii)


def scan_texts(texts: DataFrame, keys: Sequence[str], cfg: ScanConfig | None = None) -> DataFrame:
    """Sanitise, decode and scan text fields; one collapsed finding per (keys, detector, type, value).

    ``texts``: keys, field_no, path, text, source_filename. A budget takes the rows of the keys in the
    order they come in, which must follow each other.
    """
    cfg = cfg or ScanConfig()
    keys = list(keys)
    x = filters.drop_allowed_paths(texts, cfg.allow_paths)
    x = textprep.sanitize_frame(x)
    if cfg.decode:
        x = textprep.decode_fields(x, max_depth=cfg.decode_depth, max_len=cfg.max_decoded).drop("encoding")
    else:
        x = x.withColumn("variant", F.array().cast("array<int>"))
    if cfg.budget is not None:
        x = textprep.budget_decoded(x, keys, cfg.budget)
    if cfg.distinct_texts:
        found = _scan_distinct(x, keys, cfg)
    else:
        found = _detect(x, keys, cfg)
    if cfg.stop_at_block and (cfg.entropy_gate or cfg.plugins.detectors):  # else cut inside the row
        found = detect.stop_after_block(found, [*keys, "field_no", "variant"])
    found = policy.collapse(found, keys, ORDER)
    return found.withColumn("action", policy.resolve_action(cfg.overrides, cfg.default_action))


def _scan_distinct(x: DataFrame, keys: list[str], cfg: ScanConfig) -> DataFrame:
    """Scan one copy of each text and hand its findings to every copy.

    Only hashes and findings are shuffled back; a text copied a million times is scanned
    once. Worth its shuffle when copies are common.
    """
    h = x.withColumn("_h", F.sha2("text", 256))
    once = h.groupBy("_h").agg(F.first("text").alias("text")).select("_h", F.lit(0).alias("field_no"), F.array().cast("array<int>").alias("variant"), F.lit("").alias("path"), "text", F.lit("").alias("source_filename"))
    found = _detect(once, ["_h"], cfg).drop("field_no", "variant", "location")
    where = h.select(*keys, "field_no", "variant", F.col("path").alias("location"), "_h")
    return where.join(found, "_h").drop("_h")


def scan_requests(requests: DataFrame, cfg: ScanConfig | None = None, key: str = "req_id", body: str = "body",
                  provider: str | None = "provider") -> DataFrame:
    """Findings of a request log: extract, then :func:`scan_texts`.

    With a budget the newest fields come first, and what is decoded counts, as it is scanned too.
    """
    cfg = cfg or ScanConfig()
    req = spread(requests.select(key, body, *([provider] if provider else [])))
    arr = extract.extract_fields(req, body, provider, as_array=True)
    if cfg.budget is not None:
        arr = arr.withColumn("fields", F.reverse("fields"))
    return scan_texts(extract.explode_fields(arr).select(key, "field_no", "path", "text", "source_filename"), [key], cfg)


def request_results(requests: DataFrame, findings: DataFrame, cfg: ScanConfig | None = None, key: str = "req_id") -> DataFrame:
    """Decided requests, by the evaluate hook or the policy; post-scan hooks are called with them."""
    cfg = cfg or ScanConfig()
    return finish(cfg.plugins.run_evaluate(findings, lambda f: policy.request_verdicts(requests, f, [key], cfg.default_action, ORDER)), cfg)


def finish(results: DataFrame, cfg: ScanConfig) -> DataFrame:
    """Results of a job on their way out: hooks that wait for them get them first."""
    return cfg.plugins.run_post_scan(results)


def redact_texts(texts: DataFrame, findings: DataFrame, cfg: ScanConfig | None = None, keys: Sequence[str] = ("req_id",), text: str = "text") -> DataFrame:
    """Texts with the values of findings to redact replaced, by the redaction hook if there is one."""
    return (cfg or ScanConfig()).plugins.run_redact(texts, findings, list(keys), text)


def scan_response_texts(texts: DataFrame, cfg: ScanConfig | None = None, prefix: str = "response.", keep: Sequence[str] = ("response_id",)) -> DataFrame:
    """Findings in response texts, after the response hook has let them pass."""
    cfg = cfg or ScanConfig()
    rules = detect.active_rules(cfg.rules, licensed=cfg.licensed, skip=cfg.plugins.skip_rules)
    return tooling.scan_responses(cfg.plugins.run_response_filter(texts), rules, prefix, keep)


def tool_call_verdicts(calls: DataFrame, findings: DataFrame, cfg: ScanConfig | None = None, binding_action: str = "warn", argument_action: str = "alert", key: str = "msg_no") -> DataFrame:
    """Outcome of each tool call, the policy hook's word included."""
    return tooling.call_verdicts(calls, findings, binding_action, (cfg or ScanConfig()).plugins.run_tool_policy(calls), argument_action, key)


def client_columns(requests: DataFrame, cfg: ScanConfig | None = None, headers: str = "headers") -> DataFrame:
    """Requests with the columns of their client, extra clients included."""
    found = identity.client_columns(identity.header("user-agent", headers), F.col(headers), (cfg or ScanConfig()).plugins.clients())
    return requests.select("*", *(c.alias(n) for n, c in found.items()))


def scan_documents(docs: DataFrame, cfg: ScanConfig | None = None, key: str = "file", text: str = "text", baseline: DataFrame | None = None) -> DataFrame:
    """Findings per file or document; an accepted baseline is left out."""
    cfg = cfg or ScanConfig()
    x = spread(docs.select(F.col(key).alias("_k"), F.col(text).alias("text"))).select(
        F.col("_k").alias(key), F.lit(0).alias("field_no"), F.col("_k").cast("string").alias("path"), "text", F.col("_k").cast("string").alias("source_filename"))
    found = scan_texts(x, [key], cfg)
    return governance.suppress_baseline(found, baseline, file=key) if baseline is not None else found


def scan_diffs(diffs: DataFrame, cfg: ScanConfig | None = None, key: str = "diff_id", diff: str = "diff", baseline: DataFrame | None = None) -> DataFrame:
    """Findings in the added lines of each file of each diff."""
    x = files.diff_files(spread(diffs), key, diff)
    fields = x.select(key, "file", F.lit(0).alias("field_no"), F.col("file").alias("path"), "text", F.col("file").alias("source_filename"))
    found = scan_texts(fields, [key, "file"], cfg)
    return governance.suppress_baseline(found, baseline, file="file") if baseline is not None else found
