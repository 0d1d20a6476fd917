"""ASCII texts go through the batch scan, with the same matches; masks are made once."""

import random

import pytest
from second_opinion import candidates
from test_masking import SHAPES

from cloakwork.functions.detection import with_candidates
from cloakwork.functions.scan import SAMPLE, SLICE, foldable, to_re2
from cloakwork.operators import analyze, mask
from cloakwork.plans import queries
from cloakwork.sources.rules import Rule, active_rules, default_rules


def test_rules_are_spelled_for_batches():
    assert [r.pattern for r in default_rules() if to_re2(r.regex, r.ignore_case) is None] == ["unicode"]
    for other in ("a*", r"\b", "(?=a)b", "(?<!a)b", "a.c", "^a", "a$", r"(a)\1", "a++", "é", r"xé", "a{1001}", r"\w|"):
        assert to_re2(other) is None, other


def test_scanned_texts_match_as_python_does(spark):
    rng = random.Random(9)
    texts = [rng.choice(["", " ", "\n", "x"]).join(rng.choice(SHAPES) for _ in range(rng.randint(1, 80))) for _ in range(200)]
    texts += [None, "", " ", "\x00", "\x01a@b.de\x02", "\x00a@b.de", "é a@b.de 4111111111111111", "a@b.de" + " plain words" * (SLICE // 10) + " a@b.de 123-45-6789"]
    rules = active_rules() + [Rule(200, "X", "look", r"(?<=ssn )\d+"), Rule(201, "X", "word", r"\bgit\w*")]
    names = {(r.entity_type, r.pattern): r.ord for r in rules}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = with_candidates(df, "text", rules, "c")
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString()
    for r in out.select("doc_id", "c").collect():
        want = sorted((s, e, names[kind, name]) for s, e, _, kind, name in candidates(texts[r.doc_id] or "", rules))
        assert sorted((s.start, s.end, s.seq) for s in r.c) == want, texts[r.doc_id][:200]


def test_rules_that_name_a_stand_in_are_not_folded():
    named = [r.pattern for r in default_rules() if not foldable(r.regex, r.ignore_case)]
    assert named == ["standard", "unicode", "unicode_simple", "unicode_domain", "quoted", "google_api", "github_token", "github_oauth", "stripe_live", "stripe_test", "jwt"]
    for other in ("[A-z]", "[ -~]", "[^_]", "a_b", r"a\x1f", r"[\x00-\x20]", r"[a\u0080-\u00ff]", "[^A-z]", "a\x03"):
        assert not foldable(other), other
    for other in (r"[^\s@]+", r"[\w.-]+", r"[-.\s/]?", r"[\]a]", "git hub"):
        assert foldable(other), other


def test_texts_beyond_ascii_go_through_the_batch_scan(spark):
    rng = random.Random(11)
    strange = ["é", "ß", "中文", "\u0301", "\u00a0", "\u2028", "\u3000", "😀", "²", "Ⅷ", "İ", "ſ", "K", "\x01", "\x02", "\x03", "\x1f", "_", "٣", "x٣٤", "\ufeff", "\U00010000"]
    glue = ["", " ", "\n", "x", "-", "5", *strange]
    texts = ["".join(rng.choice(SHAPES) + rng.choice(glue) + rng.choice(glue) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -.()+/x_Aab:" + "éß中😀\u00a0\u0301²") for _ in range(rng.randint(5, 90))) for _ in range(600)]
    rules = active_rules() + [Rule(200, "X", "gap", r"\d[^0-9a-z]\d"), Rule(201, "X", "word", r"\b\w+\s\w+\b")]
    names = {(r.entity_type, r.pattern): r.ord for r in rules}
    out = with_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "text", rules, "c")
    for r in out.select("doc_id", "c").collect():
        want = sorted((s, e, names[kind, name]) for s, e, _, kind, name in candidates(texts[r.doc_id], rules))
        assert sorted((s.start, s.end, s.seq) for s in r.c) == want, texts[r.doc_id][:200]


def test_java_reads_few_rules_beyond_ascii(spark):
    """A digit rule's class beyond ASCII stands in the plan only for texts that hold other digits."""
    df = spark.createDataFrame([(1, "é 4111111111111111")], "doc_id long, text string")
    plan = with_candidates(df, "text", active_rules(entity_types=["CREDIT_CARD"]), "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "_digest_odd_" in plan and "_digest_uneven_" not in plan


@pytest.mark.parametrize("name", ["a3_vault_sink", "f2_overwrite"])
def test_contacts_are_masked_once(spark, tiny, monkeypatch, name):
    ran, mask_table = spark.sparkContext.accumulator(0), queries.mask_table

    def counted(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    def told(*args, **options):
        out = mask_table(*args, **options)
        return out.mapInArrow(counted, out.schema)

    monkeypatch.setattr(queries, "mask_table", told)
    queries.REGISTRY[name](spark, tiny).count()
    assert ran.value == spark.read.parquet(f"{tiny}/customer.parquet").count()


def test_masks_take_one_step(spark):
    """Rules and overlaps take one pass over Arrow batches, and no rule stands in the plan."""
    df = spark.createDataFrame([(1, "é a@b.de 123-45-6789")], "doc_id long, text string")
    plan = mask.mask_table(df, session="doc_id").select("masked_text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "RLIKE" not in plan and "regexp_replace" not in plan


@pytest.mark.parametrize("mode", ["compat", "longest"])
def test_one_step_gives_what_two_give(spark, monkeypatch, mode):
    rng = random.Random(17)
    strange = ["é", "ß", "中文", "\u0301", "\u00a0", "\u2028", "😀", "²", "Ⅷ", "İ", "ſ", "K", "\x01", "\x02", "\x03", "\x1f", "_", "٣", "x٣٤", "１２", "\U00010000"]
    glue = ["", " ", "\n", "x", "-", "5", "@", "a@b.cc0", "'", '"', *strange]
    texts = ["".join(rng.choice(SHAPES) + rng.choice(glue) + rng.choice(glue) for _ in range(rng.randint(1, 30))) for _ in range(5 * SAMPLE)]
    texts += ["".join(rng.choice("0123456789 -.()+/x_Aab:@." + "éß中😀\u00a0\u0301²٣１") for _ in range(rng.randint(5, 90))) for _ in range(9 * SAMPLE)]
    texts += ["".join(rng.choice([" ", "a", ".", "-", "@", "b.cd", "%", "|", "é"]) for _ in range(rng.randint(5, 40))) for _ in range(9 * SAMPLE)]
    texts += ["plain words"] * (5 * SAMPLE) + ["x 07123 456789 gho_" + "a1" * 18, None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)

    def rows():
        some = mask.mask_table(df, session="doc_id", mode=mode, entities_to_mask=["EMAIL_ADDRESS", "PHONE_NUMBER"]).drop("text")
        hashed = mask.mask_table(df, session="doc_id", mode=mode, strategy="HASH").drop("text")
        return [sorted(out.collect()) for out in (mask.mask_table(df, session="doc_id", mode=mode), some, hashed, analyze.analyze(df, mode=mode))]

    got = rows()
    for module in (mask, analyze):
        monkeypatch.setattr(module, "in_one_step", lambda rules: False)
    for new, old in zip(got, rows()):
        for a, b in zip(new, old, strict=True):
            assert a == b, texts[a.doc_id]


def test_rules_of_other_dialects_stay_with_java(spark):
    for regex, value in ((r"(?<=ssn )\d+", "12"), (r"\p{Lu}{3}", "ABC")):
        df = spark.createDataFrame([(1, "ssn 12 ABC")], "doc_id long, text string")
        out = mask.mask_table(df, session="doc_id", rules=[*active_rules(), Rule(200, "X", "x", regex)]).first()
        assert [(p.token, p.value) for p in out.token_map] == [("{{__OWL:X_1__}}", value)]


def test_long_runs_beyond_ascii_cost_their_length(spark):
    texts = ["é " + "ab.%" * 50_000 + " a@b.de", "٣ " + "a-" * 100_000 + "@ a@b.de", "é " + "a@" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [p.value for p in r.token_map] for r in mask.mask_table(df, session="doc_id").select("doc_id", "token_map").collect()}
    assert out == {0: ["a@b.de"], 1: ["a@b.de"], 2: []}
