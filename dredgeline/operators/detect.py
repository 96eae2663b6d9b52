"""Detectors: rule scan, keyword and file checks, injection and poisoning packs, entropy sweep.

A scan is one projection over the text column: every rule becomes a guarded
``regexp_extract_all`` and the matches of a row are exploded afterwards. There is no join
with the rule table and no shuffle; a row without any match costs only its guards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dredgeline.functions import catalogue as cat
from dredgeline.functions import text as tx
from dredgeline.functions import validators as val

RULE_SCHEMA = T.StructType(
    [
        T.StructField("rule_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("detector", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("tier", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("validator", T.StringType()),
        T.StructField("entropy_context", T.BooleanType()),
        T.StructField("hit_count", T.LongType()),
    ]
)


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    detector: str = "custom"
    severity: str = "high"
    action: str = ""
    validator: str = ""
    entropy_context: bool = False
    tags: tuple[str, ...] = ()
    description: str = ""
    tier: str = "community"
    source: str = "import"
    enabled: bool = True
    hit_count: int = 0
    rule_id: int = 0
    use_group: bool = True  # take group 1 as the value when it took part
    namespace_id: int = 1

    @property
    def java(self) -> str:
        return cat.JAVA_FLAGS + java_pattern(self.pattern)

    @property
    def groups(self) -> int:
        return re.compile(self.pattern).groups if self.use_group else 0


def _pack(rows: Sequence[tuple], **kw) -> list[Rule]:
    return [
        Rule(n, p, d, s, validator=v, entropy_context=e, tags=tuple(t), description=ds or n.replace("_", " "), rule_id=i + 1, **kw)
        for i, (n, p, d, s, v, e, t, ds) in enumerate(rows)
    ]


def community_rules() -> list[Rule]:
    return _pack(cat.COMMUNITY_RULES)


def pii_rules() -> list[Rule]:
    return _pack(cat.PII_PACK, use_group=False)


def secrets_rules() -> list[Rule]:
    return [r for r in community_rules() if r.detector == "secrets"]


def injection_rules(rules: Iterable[Rule] | None = None) -> list[Rule]:
    """The injection rules of a rule table, or the built-in pack when it has none."""
    found = [r for r in rules or [] if r.detector == "injection"]
    return found or _pack(cat.INJECTION_PACK, use_group=False)


def poison_rules(action: str = "alert") -> list[Rule]:
    return [Rule(n, p, "mcp_tool_poison", "high", action=action, rule_id=i + 1, use_group=False)
            for i, (n, p) in enumerate(cat.POISON_PACK)]


def java_pattern(pattern: str) -> str:
    """Named groups and their references in the dialect of the scan, which has no underscore in names."""
    names = {n: f"g{i}" for i, n in enumerate(re.findall(r"\(\?P<(\w+)>", pattern))}
    for n, g in names.items():
        pattern = pattern.replace(f"(?P<{n}>", f"(?<{g}>").replace(f"(?P={n})", f"\\k<{g}>")
    return pattern


def valid_regex(pattern: str) -> bool:
    """True if the scan's own engine takes the pattern (tested on the driver) and its groups can be counted."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm if spark else None
    if jvm is None:
        return True
    try:
        jvm.java.util.regex.Pattern.compile(cat.JAVA_FLAGS + java_pattern(pattern))
    except Exception:  # noqa: BLE001  a Java error that only names the pattern
        return False
    return True


def active_rules(
    rules: Iterable[Rule],
    licensed: bool = False,
    detector: str | None = None,
    tier: str | None = None,
    skip: Iterable[str] = (),
    namespace_id: int = 1,
) -> list[Rule]:
    """Rules a scan will run: enabled, licensed tier, not skipped, valid; hottest first."""
    skipped = set(skip)
    kept = [
        r
        for r in rules
        if r.enabled
        and r.namespace_id == namespace_id
        and (licensed or r.tier != "pro")
        and (detector is None or r.detector == detector)
        and (tier is None or r.tier == tier)
        and r.name not in skipped
        and valid_regex(r.pattern)
    ]
    return sorted(kept, key=lambda r: (-r.hit_count, r.rule_id))


def rules_frame(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [
        (r.rule_id, r.name, r.pattern, r.detector, r.severity, r.action, r.enabled, r.tier, r.source, r.description,
         list(r.tags), r.validator, r.entropy_context, r.hit_count)
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_from_frame(df: DataFrame, max_rules: int = 5000) -> list[Rule]:
    """Read a rule table to the driver: a plan is generated from it, so its size is checked."""
    rows = df.limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"rule table holds more than {max_rules} rows; split the scan by detector")
    cols = set(df.columns)
    pick = lambda r, c, d: r[c] if c in cols and r[c] is not None else d
    return [
        Rule(r["name"], r["pattern"], pick(r, "detector", "custom"), pick(r, "severity", "high"), pick(r, "action", ""),
             pick(r, "validator", ""), pick(r, "entropy_context", False), tuple(pick(r, "tags", ())),
             pick(r, "description", ""), pick(r, "tier", "community"), pick(r, "source", "import"),
             pick(r, "enabled", True), pick(r, "hit_count", 0), pick(r, "rule_id", i + 1))
        for i, r in enumerate(rows)
    ]


# ---- rule scan -------------------------------------------------------------------------
# Letters from rare to frequent in prose. A search stops at every place that holds the first byte of what
# it looks for, and what it does there costs far more than a step: it pays to look for a rare letter.
_RARE = "jqxzkvwyfpbgmcudlhsroaitne"


def _rare_tail(word: str) -> str:
    """The end of a literal from its rarest letter on, not so short that most texts hold it."""
    starts = range(max(1, len(word) - 2))
    if len(word) == 3:
        starts = range(2)
    return word[min(starts, key=lambda k: _RARE.find(word[k])):]


def _contains_sql(word: str) -> str:
    """True if the text holds the literal; the search for its rare end, shorter or as long, rules out most texts."""
    return " AND ".join(f"contains(_lower, {tx.sql_str(x)})" for x in dict.fromkeys((_rare_tail(word), word)))


def _holds(column: str, letters: str) -> Column:
    """True if the text holds any of the letters; byte searches, far cheaper than a pattern."""
    return reduce(or_, (F.contains(column, F.lit(c)) for c in letters))


# What guards, and rules for tokens, look at in place of the text. A word is plain if it is short and of letters and a few
# signs. A plain word goes if what follows begins like one, so that the word before a colon or an equals sign stays. Two
# white spaces take its place: no rule that runs on what is left reaches over them.
_MARKS = ",.;!?"
_PLAIN = f"[a-zA-Z{_MARKS}\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u017e]"
_KEPT = f"regexp_replace(_text, {tx.sql_str(rf'(?:\s++{_PLAIN}{{1,{cat.RUN - 1}}}+(?=\s++{_PLAIN}))++')}, '  ')"
# Of these, words with a digit in them. Two such words that follow each other keep the white space between them, others
# are set apart by a zero character.
_NUM = r"(?U)(?<!\S)[^\s\d]*+\d\S*+(?:\s(?=[^\s\d]*+\d))?"
_NUMS = (
    "CASE WHEN _kept rlike '(?U)\\\\d' THEN "
    f"regexp_replace(array_join(regexp_extract_all(_kept, {tx.sql_str(_NUM)}, 0), '\\0'), {tx.sql_str('(?U)(' + chr(92) + 's)' + chr(92) + 'x00')}, '$1') WHEN _kept IS NOT NULL THEN '' END")


def _stays(word: str) -> bool:
    """True if no plain word holds the literal."""
    return not re.search(r"\s", word) and (len(word) >= cat.RUN or any(x.isascii() and not x.isalpha() and x not in _MARKS for x in word))


def _guard_sql(rule: Rule) -> str | None:
    shipped = rule.name in cat.GUARDS and _guard_applies(rule)
    literals, features = cat.GUARDS[rule.name] if shipped else _needs(rule)
    terms = [f"_f_{f}" for f in features]
    if shipped:
        terms += [g for g, names in (("_long", cat.WITH_LONG), ("_sign", cat.WITH_SIGN)) if rule.name in names]
    short = shipped and rule.name in cat.IN_RUN | cat.BEFORE_SIGN
    for group in sorted(literals, key=lambda g: not all(map(_stays, g))):
        column = "_nums" if _in_numbers(rule) else "_runs" if short or all(map(_stays, group)) else ""
        terms.append("(" + " OR ".join(f"contains({column}, {tx.sql_str(x)})" if column else f"({_contains_sql(x)})" for x in group) + ")")
    return " AND ".join(terms) if terms else None


_REPEATS = (re._constants.MAX_REPEAT, re._constants.MIN_REPEAT, re._constants.POSSESSIVE_REPEAT)
_DIGITS = (re._constants.CATEGORY, re._constants.CATEGORY_DIGIT)


def _items(rule: Rule) -> list:
    try:
        return list(re._parser.parse(rule.pattern))
    except re.error:
        return []


def _needs(rule: Rule) -> tuple[list[list[str]], list[str]]:
    """Literals and features that every match of a pattern holds: those of its parts that no match can leave out."""
    c = re._constants
    literals, digits = [], 0

    def walk(items) -> None:
        nonlocal digits
        run = ""
        for op, arg in [*items, (None, None)]:
            if op is c.LITERAL and 0x20 < arg < 0x7F:
                run += chr(arg).lower()
                continue
            if len(run) > 2 or any(not x.isalnum() for x in run):
                literals.append([run])
            run = ""
            if op is c.SUBPATTERN:
                walk(arg[3])
            elif op is c.ATOMIC_GROUP:
                walk(arg)
            elif op in _REPEATS and arg[0] > 0:
                walk(arg[2])
                if list(arg[2]) == [(c.IN, [_DIGITS])]:
                    digits = max(digits, arg[0])
            elif op is c.BRANCH:
                own, kept = [], len(literals)
                for branch in arg[1]:
                    walk(branch)
                    own.append(max((g[0] for g in literals[kept:] if len(g) == 1), key=len, default=""))
                    del literals[kept:]
                if all(own):
                    literals.append(list(dict.fromkeys(own)))

    walk(_items(rule))
    if "|" in rule.pattern:  # a run of digits of one branch need not be in the others
        digits = 0
    literals.sort(key=lambda g: -min(map(len, g)))
    return literals[:2], ["digit8"] if digits >= 8 else ["digit3"] if digits >= 3 else []


def _in_numbers(rule: Rule) -> bool:
    """True if all matches are words with a digit in each, one white space at most between two of them and none at the ends."""
    if rule.name in cat.GUARDS and _guard_applies(rule):
        return rule.name in cat.NUMERIC
    c = re._constants
    solid = lambda x: x == _DIGITS or (x[0] is c.LITERAL and 0x20 < x[1] < 0x7F) or (x[0] is c.RANGE and 0x20 < x[1][0] and x[1][1] < 0x7F)
    white = lambda x: x in ((c.CATEGORY, c.CATEGORY_SPACE), (c.LITERAL, 0x20))
    digit = False
    for op, arg in _items(rule):
        least, most, one = (arg[0], arg[1], list(arg[2])) if op in _REPEATS else (1, 1, [(op, arg)])
        if one == [(c.AT, c.AT_BOUNDARY)]:
            continue
        if len(one) != 1:
            return False
        of = one[0][1] if one[0][0] is c.IN else one
        if all(map(solid, of)):
            digit = digit or (least > 0 and list(of) == [_DIGITS])
        elif digit and most == 1 and all(solid(x) or white(x) for x in of):
            digit = False  # the next word needs one of its own
        else:
            return False
    return digit


def _searched(rule: Rule, guarded: bool) -> str:
    """The column that a rule runs on."""
    if not guarded:
        return "_text"
    return "_nums" if _in_numbers(rule) else "_kept" if rule.name in cat.SOLID and _guard_applies(rule) else "_text"


def _guard_applies(rule: Rule) -> bool:
    """A guard belongs to a pattern, not to a name: user rules may reuse a shipped name."""
    return any(rule.name == n and rule.pattern == p for n, p, *_ in
               cat.COMMUNITY_RULES + cat.PII_PACK + cat.INJECTION_PACK)


_LAZY_HEAD = r"[\w.-]{0,50}?"


def _sure_group(rule: Rule) -> bool:
    """True if group 1 takes part in every match and is never empty, so that it is always the value."""
    if not rule.groups:
        return False
    items = re._parser.parse(rule.pattern)
    return any(op is re._constants.SUBPATTERN and arg[0] == 1 and arg[3].getwidth()[0] > 0 for op, arg in items)


def _headless(rule: Rule) -> str:
    """The pattern of a rule whose value is group 1, without a lazy run before its keyword.

    The run only moves the start of the match: the keyword taken is the first one that goes on to a
    match, with or without it, and the match ends at the same place.
    """
    p = rule.pattern
    for flags in ("(?i)", ""):
        if p.startswith(flags + _LAZY_HEAD):
            p = flags + p[len(flags + _LAZY_HEAD):]
            inner = "(?i:" + _LAZY_HEAD
            return "(?i:" + p[len(inner):] if p.startswith(inner) else p
    return p


def _first_letters(items) -> set[str] | None:
    """The characters a match can begin with, in either case; None if they are not few and known."""
    c = re._constants
    for op, arg in items:
        if op is c.LITERAL:
            x = chr(arg)
            return {x.lower(), x.upper()} | set({"s": "\u017f", "i": "\u0131\u0130", "k": "\u212a"}.get(x.lower(), "")) if "!" < x < "\x7f" else None
        if op is c.SUBPATTERN:
            return _first_letters(arg[3])
        if op is c.BRANCH:
            own = [_first_letters(x) for x in arg[1]]
            return set().union(*own) if all(own) else None
        return None
    return None


def _ahead(pattern: str) -> str:
    """A look at the first character, which rules out most places of a text before the pattern is tried there."""
    try:
        first = _first_letters(re._parser.parse(pattern))
    except re.error:
        first = None
    return f"(?=[{''.join(rf'\x{{{ord(x):x}}}' for x in sorted(first))}])" if first else ""


def _matches_sql(rule: Rule, text: str) -> str:
    if _sure_group(rule):
        p = _headless(rule)
        return f"regexp_extract_all({text}, {tx.sql_str(cat.JAVA_FLAGS + _ahead(p) + java_pattern(p))}, 1)"
    p = tx.sql_str(cat.JAVA_FLAGS + _ahead(rule.pattern) + java_pattern(rule.pattern))
    whole = f"regexp_extract_all({text}, {p}, 0)"
    if rule.groups:  # the second pass is for texts with a match
        return f"flatten(transform(array({whole}), m -> if(size(m) = 0, m, zip_with(m, regexp_extract_all({text}, {p}, 1), (w, g) -> if(g <> '', g, w)))))"
    return whole


def _first_match_sql(rule: Rule, text: str) -> str:
    return f"filter(array(regexp_extract({text}, {tx.sql_str(rule.java)}, 0)), v -> v <> '')"


@dataclass(frozen=True)
class First:
    """Rules of which the first match of a text counts, with a location and a mask of their own, on the rows of ``where``."""

    rules: Sequence[Rule]
    location: Column
    where: Column | None = None
    mask: Callable[[Column], Column] = tx.mask_ends


def scan(
    df: DataFrame,
    rules: Sequence[Rule],
    text: str = "text",
    location: Column | str | None = None,
    first_only: bool = False,
    guards: bool = True,
    keep: Sequence[str] | None = None,
    mask=tx.mask_short,
    stop_at_block: bool = False,
    proprietary: str | None = None,
    also: First | None = None,
) -> DataFrame:
    """Run rules over a text column; one output row per accepted match.

    Output: ``keep`` columns (default: all but the text) and detector, type, severity,
    action, location, value, value_preview, rule_no (scan order) and match_no.
    ``first_only`` takes the first match of each rule (injection and poisoning packs).
    ``proprietary`` names the column of file names: file and keyword checks then are further
    arms of the same array, numbered after the rules, so the text is read once.
    ``also`` brings rules with a first match only, as arms of the same array too; their numbers start anew.
    ``stop_at_block`` drops, inside the row, matches of rules after the first accepted one that blocks.
    """
    own = len(rules)
    rules = [*rules, *(also.rules if also else ())]
    more = len(rules)
    held = {n: (s, f"CASE WHEN _sev = '{s}' THEN array(_file) END") for n, s in (("blocked_file_pattern", "critical"), ("sensitive_file_pattern", "warning"))}
    carried = [c for c in (keep if keep is not None else df.columns) if c != text]
    loc = F.lit("") if location is None else (F.col(location) if isinstance(location, str) else location)
    src = df.select(*carried, F.col(text).alias("_text"), loc.alias("_loc"), *([F.col(proprietary).alias("_file")] if proprietary else []),
                    *([also.location.alias("_also"), (F.lit(True) if also.where is None else also.where).alias("_on")] if also else []))
    guard = {r: (_guard_sql(r) if guards else None) for r in rules}
    used = " ".join(g for g in guard.values() if g)
    if used:
        # The patterns fold four letters to ASCII that lower() leaves apart.
        odd = (F.octet_length("_text") != F.length("_text")) & _holds("_text", "\u017f\u0131\u0130\u212a")
        src = src.withColumns({"_odd": odd, "_kept": F.expr(_KEPT)})
        low = lambda c: F.lower(F.when(F.col("_odd"), F.translate(c, "\u017f\u0131\u0130\u212a", "siik")).otherwise(F.col(c)))
        src = src.withColumns({"_lower": low("_text"), "_runs": low("_kept"), "_nums": F.expr(_NUMS), "_sign": _holds("_kept", ":=")})
        src = src.withColumns({"_long": F.col("_kept").rlike(cat.LONG)} | {f"_f_{f}": F.col("_nums").rlike("(?U)" + rx) for f, rx in cat.FEATURES.items() if f"_f_{f}" in used})
    arms = []
    for i, r in enumerate(rules):
        one = _first_match_sql if first_only or i >= own else _matches_sql
        arm = f"transform({one(r, _searched(r, bool(guard[r])))}, (v, j) -> struct({i} as rule_no, j as match_no, v as value))"
        when = " AND ".join(x for x in (guard[r], "_on" if i >= own else None) if x)
        arms.append(f"CASE WHEN {when} THEN {arm} END" if when else arm)
    if proprietary:
        src = src.withColumns({"_up": F.upper("_text"), "_sev": _file_level("_file", cat.FILE_GLOBS_CRITICAL, cat.FILE_GLOBS_WARNING)})
        for name, severity, words in (("confidential_keyword", "critical", cat.KEYWORDS_CRITICAL), ("sensitive_keyword", "warning", cat.KEYWORDS_WARNING)):
            held[name] = (severity, f"filter(array({', '.join(map(tx.sql_str, words))}), k -> contains(_up, k))")
        for name, (severity, values) in held.items():
            arms.append(f"transform({values}, (v, j) -> struct({len(rules)} as rule_no, j as match_no, v as value))")
            rules.append(Rule(name, "", "proprietary", severity))
    if not arms:
        arms = ["cast(NULL as array<struct<rule_no int, match_no int, value string>>)"]
    hits = f"flatten(array_compact(array({', '.join(arms)})))"
    # Outer explode and a filter: a plain explode makes the optimizer infer "size(...) > 0"
    # below it, which runs every rule twice.
    found = F.expr(hits)
    if stop_at_block and any(r.action == "block" for r in rules):
        found = F.get(F.transform(F.array(found), lambda h: _upto_block(h, rules)), F.lit(0))
    out = src.select(*carried, "_loc", *(["_also"] if also else []), F.explode_outer(found).alias("_hit")).where("_hit IS NOT NULL")
    value, no = F.col("_hit.value"), F.col("_hit.rule_no")
    place, shown = F.col("_loc"), mask(value)
    if also:
        first = (no >= own) & (no < more)
        place, shown, no = F.when(first, F.col("_also")).otherwise(place), F.when(first, also.mask(value)).otherwise(shown), F.when(first, no - own).otherwise(no)
    table = ", ".join(
        f"struct({', '.join(tx.sql_str(x) for x in (r.detector, r.name, r.severity, r.action, r.validator))})" for r in rules
    ) or "struct('', '', '', '', '')"
    out = out.withColumn("_r", F.expr(f"element_at(array({table}), _hit.rule_no + 1)"))
    out = out.select(
        *carried,
        F.col("_r.col1").alias("detector"),
        F.col("_r.col2").alias("type"),
        F.col("_r.col3").alias("severity"),
        F.col("_r.col4").alias("action"),
        place.alias("location"),
        value.alias("value"),
        (F.when(F.col("_r.col1") == "proprietary", value).otherwise(shown) if proprietary else shown).alias("value_preview"),
        no.alias("rule_no"),
        F.col("_hit.match_no").alias("match_no"),
        F.col("_r.col5").alias("_validator"),
    ).where(F.col("value") != "")
    names = sorted({r.validator for r in rules if r.validator})
    return out.where(val.passes(F.col("_validator"), F.col("value"), names)).drop("_validator")


def _upto_block(hits: Column, rules: Sequence[Rule]) -> Column:
    """The hits of one text up to the first rule that blocks with an accepted match."""
    blocks = [i for i, r in enumerate(rules) if r.action == "block"]

    def accepted(h: Column) -> Column:
        names = F.get(F.array(*(F.lit(r.validator) for r in rules)), h["rule_no"])
        return h["rule_no"].isin(blocks) & (h["value"] != "") & val.passes(names, h["value"], sorted({r.validator for r in rules if r.action == "block" and r.validator}))

    cut = F.array_min(F.transform(F.filter(hits, accepted), lambda h: h["rule_no"]))
    return F.filter(hits, lambda h: h["rule_no"] <= F.coalesce(cut, F.lit(len(rules))))


def entropy_gate(findings: DataFrame, rules: Sequence[Rule], threshold: float = 4.5) -> DataFrame:
    """Drop low-entropy matches of rules flagged ``entropy_context`` (off on the rule-table path)."""
    flagged = [r.name for r in rules if r.entropy_context]
    return findings.where(~F.col("type").isin(flagged) | (tx.shannon_entropy("value") > threshold)) if flagged else findings


def stop_after_block(findings: DataFrame, field_keys: Sequence[str]) -> DataFrame:
    """Within a field, drop findings of rules that come after the first one that blocks.

    The first blocking rule per field is a partial aggregate; only that small side is joined
    back, so a field with very many matches never gathers in one task.
    """
    cut = (
        findings.where(F.col("action") == "block")
        .groupBy(*field_keys)
        .agg(F.min("rule_no").alias("_cut"))
    )
    return (
        findings.join(cut, list(field_keys), "left")
        .where(F.col("_cut").isNull() | (F.col("rule_no") <= F.col("_cut")))
        .drop("_cut")
    )


def rule_hits(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("hits"))


def add_rule_hits(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """New rule snapshot with the run's accepted matches added to ``hit_count``."""
    return (
        rules.join(rule_hits(findings), "name", "left")
        .withColumn("hit_count", F.col("hit_count") + F.coalesce("hits", F.lit(0)))
        .drop("hits")
    )


# ---- other detectors -------------------------------------------------------------------
def _finding(carried, detector, ftype, severity, location, value, preview):
    return [
        *carried,
        F.lit(detector).alias("detector") if isinstance(detector, str) else detector.alias("detector"),
        ftype.alias("type"),
        severity.alias("severity"),
        F.lit("").alias("action"),
        location.alias("location"),
        value.alias("value"),
        preview.alias("value_preview"),
    ]


def _file_level(filename: str, critical: Sequence[str], warning: Sequence[str]) -> Column:
    f = F.col(filename)
    base = F.element_at(F.split(f, "/"), -1)
    hit = lambda g: tx.matches_glob(base, g) | tx.matches_glob(f, g)
    return F.when(f == "", None).when(hit(critical), "critical").when(hit(warning), "warning")


def sensitive_files(
    df: DataFrame,
    filename: str = "source_filename",
    location: str = "path",
    critical: Sequence[str] = cat.FILE_GLOBS_CRITICAL,
    warning: Sequence[str] = cat.FILE_GLOBS_WARNING,
) -> DataFrame:
    """One finding per field whose file name (base name or whole path) matches a glob."""
    f, level = F.col(filename), _file_level(filename, critical, warning)
    ftype = F.when(F.col("_sev") == "critical", "blocked_file_pattern").otherwise("sensitive_file_pattern")
    carried = [c for c in df.columns if c not in ("text", location)]
    return (
        df.withColumn("_sev", level)
        .where(F.col("_sev").isNotNull())
        .select(*_finding(carried, "proprietary", ftype, F.col("_sev"), F.col(location), f, f))
    )


def keywords(
    df: DataFrame,
    text: str = "text",
    location: str | Column = "path",
    critical: Sequence[str] = cat.KEYWORDS_CRITICAL,
    warning: Sequence[str] = cat.KEYWORDS_WARNING,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """One finding per confidential keyword present in the text, whatever its case."""
    loc = F.col(location) if isinstance(location, str) else location
    carried = list(carry) if carry is not None else [c for c in df.columns if c != text and not (isinstance(location, str) and c == location)]
    words = [(k, "critical", "confidential_keyword") for k in critical] + [(k, "warning", "sensitive_keyword") for k in warning]
    table = F.array(*[F.struct(F.lit(k).alias("kw"), F.lit(s).alias("sev"), F.lit(t).alias("typ")) for k, s, t in words])
    up = df.withColumn("_up", F.upper(text)).withColumn(
        "_k", F.explode_outer(F.filter(table, lambda x: F.contains(F.col("_up"), x["kw"])))
    ).where("_k IS NOT NULL")
    return up.select(*_finding(carried, "proprietary", F.col("_k.typ"), F.col("_k.sev"), loc, F.col("_k.kw"), F.col("_k.kw")))


def injections(df: DataFrame, text: str = "text", location: str | Column = "response.content",
               rules: Sequence[Rule] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """First match of each injection pattern."""
    loc = F.lit(location) if isinstance(location, str) else location
    return scan(df, list(rules) if rules else injection_rules(), text, loc, first_only=True, keep=keep, mask=tx.mask_ends)


def poisoned_descriptions(tools: DataFrame, name: str = "name", description: str = "description",
                          action: str = "alert", keep: Sequence[str] | None = None) -> DataFrame:
    """First match of each poisoning pattern in a tool description (empty ones are skipped)."""
    loc = F.concat(F.lit("mcp.tools/list."), F.col(name), F.lit(".description"))
    return scan(tools, poison_rules(action), description, loc, first_only=True, keep=keep,
                mask=lambda v: F.substring(v, 1, 80))


# --- fixed values: words that mark a token as a likely secret ------------------------
SECRET_WORDS = ("key", "secret", "token", "password", "credential", "auth")


def entropy_sweep(
    df: DataFrame,
    text: str = "text",
    location: str | Column = "path",
    words: Sequence[str] = SECRET_WORDS,
    threshold: float = 4.5,
    min_len: int = 20,
    window: int = 40,
) -> DataFrame:
    """High-entropy tokens that follow a secret word within ``window`` characters."""
    rx = rf"(?i)(?:{'|'.join(words)})[^\n]{{0,{window}}}?(?<![A-Za-z0-9+/=_\-])([A-Za-z0-9+/=_\-]{{{min_len},}})"
    lower = F.lower(text)
    near = lower.rlike("|".join(words))
    loc = F.col(location) if isinstance(location, str) else location
    carried = [c for c in df.columns if c != text and not (isinstance(location, str) and c == location)]
    tokens = F.when(near, F.regexp_extract_all(F.col(text), F.lit(rx), F.lit(1)))
    out = df.select(*carried, loc.alias("_loc"), F.posexplode_outer(tokens).alias("match_no", "_v"))
    v = F.col("_v")
    return out.where(v.isNotNull()).where(tx.shannon_entropy(v) > threshold).select(
        *_finding(carried, "secrets", F.lit("high_entropy_string"), F.lit("high"), F.col("_loc"), v, tx.mask_short(v)),
        "match_no",
    )
