"""What the guards of a scan look at in place of the text."""

import random
from dataclasses import replace

from dredgeline.operators import detect, policy


def test_guards_search_few_literals_in_whole_texts():
    """Literals that lie in a run without white space, or next to digits, are searched there."""
    guards = " ".join(detect._guard_sql(r) or "" for r in detect.community_rules())
    assert "contains(_runs, 'akia')" in guards and "contains(_nums, '+1')" in guards


def test_number_words_give_the_matches_of_the_text(spark):
    """Numbers split by one or two white spaces, words, other signs and zero characters; keywords with long tokens."""
    r = random.Random(7)
    bits = ["4111", "1111 1111", "4111-1111-1111-1111", "+1", "(212)", "212-555-0123", "555-0123", "+1 212 555 0123", "(212) 555-0123", "+442071838750", "8.8.8.8", "123-45-6789",
            "GB82WEST12345698765432", "A12345678", "é9", "\u0663\u0663\u0663", "\0", "\0" + "4111", "212.555.0123", "x", "word", "AKIA" + "A1B2" * 4, "twitter = " + "a" * 25,
            "secret_key: '" + "k" * 20 + "'", "\u017fk-ant-x", "http://u:p@h/", "pwd=abcdefgh1", "\u0301" + "123-45-6789", "SK" + "0" * 32]
    texts = ["".join(r.choice(bits) + r.choice((" ", " ", "  ", "\n", "\u00a0", "\t", "", ",")) for _ in range(r.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None), (9998, "")], "id long, text string")
    for rules in (detect.community_rules(), detect.pii_rules()):
        a, b = (sorted((x.id, x.rule_no, x.match_no, x.value) for x in detect.scan(df, rules, keep=["id"], guards=g).collect()) for g in (True, False))
        assert a == b and len(a) > 500


def test_tokens_and_signs_are_searched_in_kept_words(spark, monkeypatch):
    """Prose goes before guards and token rules look; matches stay those of the text, whatever stands around them."""
    of = {r.name: r for r in detect.community_rules()}
    assert "contains(_runs, '@')" in detect._guard_sql(of["email"]) and detect._searched(of["email"], True) == "_kept"
    assert "_lower" not in detect._guard_sql(of["generic_password"]) and detect._ahead(of["generic_password"].pattern)
    prose = spark.createDataFrame([("Und\u00e9 the word, of it. " * 500 + "x@y.org and more of the",)], "_text string").selectExpr(f"{detect._KEPT} AS k").first().k
    assert len(prose) < 60 and "x@y.org" in prose
    r = random.Random(11)
    bits = ["plain", "words,", "of.", "it", "\u00fcber", "Donaudampfschifffahrtsgesellschaft", "a.b@c.org", "x@y", "password", "pwd", "to\u212aen", "\u017fecret", "api_key", ":", "=", ": 'abcdefgh ijklmnop qrst'", "= \"" + "k y" * 9 + "\"",
            "redis://u:p@h", "http://u:p@h/", "kind:", "secret", "data: k: abcdefghijkl", "<", "system", ">", "[INST]", "curl", "|", "bash", "private", "PRIVATE", "-----BEGIN", "KEY-----", "+1", "212", "(212)", "555-0123", "4111", "1111", "1111-1111",
            "AKIA" + "A1B2" * 4, "sk-" + "a" * 22, "AKIA", "A1B2" * 4, "dop_v1_" + "a" * 64, "twitter", ",", "a" * 25, "SECRET", "export", "https://hooks.slack.com/services/T0/B0/x", "1" * 16 + "|" + "a" * 30, "ignore", "previous", "instructions"]
    gaps = (" ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2028", "\x1c", "\x85", "", ",")
    texts = ["".join(r.choice(bits) + r.choice(gaps) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(9999, None), (9998, " ")], "id long, text string")
    own = [detect.Rule("email", "(?:pass|fail)ed [a-z]+@"), detect.Rule("top", "alpha|plain|word"), detect.Rule("ik", "(?i)itok|token")]
    packs = [[replace(q, validator="") for q in rules] for rules in (detect.community_rules(), detect.pii_rules())] + [own]
    found = lambda g: [sorted((x.id, x.rule_no, x.match_no, x.value) for x in detect.scan(df, rules, keep=["id"], guards=g).collect()) for rules in packs]
    fast = found(True)
    monkeypatch.setattr(detect, "_ahead", lambda pattern: "")
    assert fast == found(False) and len(fast[0]) > 1000 and len(fast[1]) > 1000 and fast[2]


def test_verdicts_and_reports_group_findings_once(spark):
    """One aggregate over the findings, which else would be scanned for once more."""
    rows = [(1, 0, 0, 0, "secrets", "k", "high", "x", "k**", "block", 1), (1, 1, 0, 0, "pii", "m", "info", "y", "m**", "log", 2)]
    found = spark.createDataFrame(rows, "req_id long, field_no int, rule_no int, match_no int, detector string, type string, severity string, location string, value_preview string, action string, count long")
    req = spark.createDataFrame([(1,), (2,)], "req_id long")
    from pyspark.sql import functions as F

    v = policy.request_verdicts(req, found, ["req_id"], "log", more=[F.array_sort(F.collect_set("type")).alias("types")])
    assert sorted(map(tuple, v.select("req_id", "action", "reason", "finding_count", "types").collect())) == [(1, "block", "k (x)", 2, ["k", "m"]), (2, "pass", "", 0, None)]
    rep = policy.scan_report(req, found, "req_id")
    assert rep._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert sorted((x.req_id, x.finding_count, x.exit_code) for x in rep.collect()) == [(1, 2, 1), (2, 0, 0)]
