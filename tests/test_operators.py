"""Restoring, resolving, spans as rows, vault, keys and audit on small fixtures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from second_opinion import keep, mask

from cloakwork.operators import audit, crypto, demask, detect, flow, spans, vault
from cloakwork.operators.analyze import analyze
from cloakwork.operators.mask import mask_table, token_rows
from cloakwork.plans.skew import join_hot, running
from cloakwork.sources.rules import default_rules, rules_frame, rules_from_frame
from cloakwork.sources.tables import masked_output, text_source

T = "{{__OWL:%s_%d__}}"
START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


# ---------------------------------------------------------------- restoring


def replay(text, pairs):
    n = 0
    for tok, value in pairs:
        if tok in text:
            text = text.replace(tok, value)
            n += 1
    return text, n


A1, A2, A10, B1 = T % ("A", 1), T % ("A", 2), T % ("A", 10), T % ("B", 1)
MAPS = {
    "plain": [(A1, "one"), (A2, "two"), (A10, "ten"), (B1, "b")],
    "nested": [(A2, f"in {A1} out"), (A1, "one"), (B1, "{{__OWL:A_")],
    "order": [(A1, "one"), (A2, f"late {A1}")],
    "empty": [],
}
TEXTS = [
    f"x {A1} y {A1} {A10}", f"{A1}{A2}", f"{A2}!", f"{B1}1__}}}} {A2}", "nothing", f"{{{{__OWL:A_{A1}", f"{{{A1}}}", "", f"{T % ('C', 4)} {A1}",
]


def test_demask_by_map_and_by_session(spark):
    rows, vault_rows = [], []
    for name, pairs in MAPS.items():
        vault_rows += [(name, i, tok, value) for i, (tok, value) in enumerate(pairs)]
        rows += [(f"{name}-{i}", name, text, pairs) for i, text in enumerate(TEXTS)]
    rows.append(("lost", "no such session", f"keep {A1}", []))
    df = spark.createDataFrame(rows, "reply_id string, session_id string, text string, m array<struct<token:string,value:string>>")
    vaulted = spark.createDataFrame(vault_rows, "session_id string, ord int, token string, value string")
    want = {r[0]: replay(r[2], r[3]) for r in rows}
    direct = demask.demask(df, "text", "m").collect()
    assert {r.reply_id: (r.original_text, r.entities_restored) for r in direct} == want
    by_session = demask.demask_sessions(df, vaulted).collect()
    assert {r.reply_id: (r.original_text, r.entities_restored) for r in by_session} == want


def test_rows_are_told_apart_by_session_not_by_key(spark):
    df = spark.createDataFrame(
        [(1, "s", f"x {A1}"), (1, "t", f"x {A1}"), (1, "t", f"y {A1} {A2}"), (None, "s", A1), (None, None, A1), (1, "t", f"x {A1}")],
        "reply_id long, session_id string, text string",
    )
    vaulted = spark.createDataFrame([("s", 0, A1, "of s"), ("t", 0, A1, "of t")], "session_id string, ord int, token string, value string")
    want = [(1, "s", "x of s"), (1, "t", "x of t"), (1, "t", "x of t"), (1, "t", f"y of t {A2}"), (None, "s", "of s"), (None, None, A1)]
    rows = demask.demask_table(df, session="session_id", vault=vaulted)
    assert sorted(((r.reply_id, r.session_id, r.original_text) for r in rows.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(r.original_text for r in demask.demask_sessions(df, vaulted).collect()) == sorted(w[2] for w in want)
    lost = demask.unresolved_tokens(df, vaulted.filter("session_id = 's'"), "reply_id", "text").collect()
    assert sorted((str(r.reply_id), str(r.session_id), r.token) for r in lost) == [("1", "t", A1), ("1", "t", A2), ("None", "None", A1)]
    asked = df.select(F.col("reply_id").alias("request_id"), F.lit("").alias("user_input"), F.col("text").alias("llm_response"), "session_id", F.lit("n").alias("new_id"))
    answers = flow.second_step(asked, vaulted).collect()
    assert sorted(((r.session_id, r.demasked_response) for r in answers)) == sorted(w[1:] for w in want if w[1])


def test_repeated_keys_do_not_repeat_findings(spark):
    df = spark.createDataFrame([(1, "a@b.com 123-45-6789"), (1, "c@d.com"), (1, "a@b.com 123-45-6789"), (None, "c@d.com")], "doc_id long, text string")
    assert sorted(map(str, detect.detect_distinct(df).collect())) == sorted(map(str, detect.candidate_spans(df).collect()))


def test_demask_needs_a_source(spark):
    df = spark.createDataFrame([(1, "s", A1, [(A1, "one")])], "reply_id long, session_id string, text string, m array<struct<token:string,value:string>>")
    with pytest.raises(ValueError, match="Must provide either session_id or token_map"):
        demask.demask_table(df)
    vaulted = spark.createDataFrame([("s", 0, A1, "two")], "session_id string, ord int, token string, value string")
    assert demask.demask_table(df, pairs="m").first().original_text == "one"
    assert demask.demask_table(df, session="session_id", vault=vaulted).first().original_text == "two"


def test_resolve(spark):
    vaulted = spark.createDataFrame([("s", 0, A1, "one"), ("s", 1, A2, "two")], "session_id string, ord int, token string, value string")
    asked = spark.createDataFrame([(1, "s", [A1, "?", A1]), (2, "gone", [A1])], "request_id long, session_id string, tokens array<string>")
    got = {(r.request_id, r.token, r.value) for r in demask.resolve_tokens(asked, vaulted).collect()}
    assert got == {(1, A1, "one"), (1, "?", "?")}
    got = {(r.request_id, r.token, r.value) for r in demask.resolve_tokens(asked, vaulted, "identity").collect()}
    assert got == {(1, A1, "one"), (1, "?", "?"), (2, A1, A1)}
    counts = demask.resolve_counts(asked, vaulted).collect()
    assert [(r.request_id, r.tokens_requested, r.tokens_resolved) for r in counts] == [(1, 3, 2)]
    lost = demask.unresolved_tokens(
        spark.createDataFrame([(1, "s", f"{A1} {A10}")], "reply_id long, session_id string, text string"), vaulted, "reply_id", "text"
    )
    assert [(r.reply_id, r.token) for r in lost.collect()] == [(1, A10)]


def test_flow(spark):
    asked = spark.createDataFrame(
        [(1, "SSN 123-45-6789", None, None, "n1"), (2, "", f"hello {A1}", "s", "n2"), (3, "", "", "s", "n3")],
        "request_id long, user_input string, llm_response string, session_id string, new_id string",
    )
    vaulted = spark.createDataFrame([("s", 0, A1, "one")], "session_id string, ord int, token string, value string")
    got = {r.request_id: r for r in flow.run_flow(asked, vaulted, "new_id")[0].collect()}
    assert got[1].masked_input == f"SSN {T % ('US_SSN', 1)}" and got[1].session_id == "n1"
    assert got[2].demasked_response == "hello one" and got[2].masked_input == ""
    assert got[3].error == flow.FLOW_ERROR and got[3].demasked_response is None


def test_roundtrip_and_sink(spark):
    df = spark.createDataFrame([(1, 'a@b.com and "quoted" 123-45-6789'), (2, None), (3, "")], "doc_id long, text string")
    masked = mask_table(df, session="doc_id")
    assert demask.roundtrip_failures(masked).count() == 0
    assert masked_output(masked).columns == ["doc_id", "masked_text", "entities_found", "session_id"]
    assert {r.doc_id: r.entities_found for r in masked_output(masked).collect()} == {1: 3, 2: 0, 3: 0}
    assert [r.ord for r in token_rows(masked, "session_id").orderBy("ord").collect()] == [0, 1, 2]


def test_filters_do_not_copy_the_masking(spark):
    df = spark.createDataFrame([(1, "a@b.com"), (2, "no")], "doc_id long, text string")
    hits = mask_table(df, session="doc_id").filter((F.size("entities_found") > 0) & (F.col("doc_id") > 0))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.split("\n") if "Filter" in line) < 2000
    assert [r.doc_id for r in hits.collect()] == [1]


# ---------------------------------------------------------------- strategies and rules


def test_strategies(spark):
    df = spark.createDataFrame([(1, "a user@mail.example.com and 123-45-6789 user@mail.example.com")], "doc_id long, text string")

    def run(name, **kw):
        return mask_table(df, session="doc_id", strategy=name, **kw).first()

    assert run("REDACT").masked_text == "a [REDACTED] and [REDACTED] [REDACTED]"
    assert run("TRUNCATE").masked_text == "a user@***.com and ***6789 user@***.com"
    assert run("HASH").masked_text.count("b4c9a289323b21a01c3e940f150eb9b8c542587f1abfd8f0e1cc1ffc5e475514") == 0
    tokens = run("TOKENIZE")
    assert len(tokens.token_map) == 2 and demask.demask(mask_table(df, session="doc_id", strategy="TOKENIZE")).first().original_text == tokens.text
    same = run("SYNTHETIC")
    assert same.masked_text == run("SYNTHETIC").masked_text and "6789" not in same.masked_text and same.token_map == []


def test_rules_as_a_table(spark):
    frame = rules_frame(spark)
    assert rules_from_frame(frame) == default_rules()
    many = spark.range(6000).select(F.col("id").cast("int").alias("ord"), *[F.lit(x).alias(n) for n, x in
        (("entity_type", "X"), ("pattern", "p"), ("regex", "x"), ("ignore_case", False), ("enabled", True), ("gate", ""))])
    assert len(rules_from_frame(many)) == 6000


def test_model_hook_survives_failures(spark):
    def load():
        def predict(texts):
            if any("boom" in text for text in texts):
                raise RuntimeError("boom")
            return [[("medical license", 0, 3, 0.9), ("house number", 1, 2, 0.4)] for _ in texts]

        return predict

    df = spark.createDataFrame([(1, "boom 123-45-6789"), (2, "abc def"), (3, "  ")], "doc_id long, text string")
    failed = spark.sparkContext.accumulator(0)
    found = detect.model_spans(df, load, failures=failed)
    assert {(r.doc_id, r.entity_type) for r in detect.map_labels(found).collect()} == {(2, "MEDICAL_LICENSE"), (2, "HOUSE_NUMBER")}
    assert failed.value == 1
    both = analyze(detect.with_external(df, found, threshold=0.5), external="external")
    assert {r.doc_id: [f.entity_type for f in r.found] for r in both.collect()} == {1: ["US_SSN"], 2: ["MEDICAL_LICENSE"], 3: []}


def test_copies_are_matched_once(spark):
    df = spark.createDataFrame([(i, "same 123-45-6789" if i % 3 else f"own {i} a{i}@b.com") for i in range(300)], "doc_id long, text string")
    once = detect.detect_distinct(df)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, detect.candidate_spans(df).collect()))


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "text": "a@b.com"}\n')
    got = text_source(spark, str(tmp_path / "a.json"), "json", "id long, text string")
    assert mask_table(got, session="id").first().masked_text == T % ("EMAIL_ADDRESS", 1)
    with pytest.raises(ValueError):
        text_source(spark, str(tmp_path / "a.json"), "json")


# ---------------------------------------------------------------- spans as rows


def random_spans(n, docs, seed):
    rng, rows = random.Random(seed), []
    for seq in range(n):
        start = rng.randint(0, 400)
        rows.append((rng.randrange(docs), start, start + rng.randint(1, 40), seq, rng.choice([0.6, 0.95, 0.95, 0.99]), rng.choice("AB")))
    return rows


def test_span_rows_same_as_plain_reading(spark):
    rows = random_spans(400, 5, 1)
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, seq int, score double, entity_type string")
    kept = spans.resolve_overlaps(df)
    got = {(r.doc_id, r.seq) for r in kept.collect()}
    want, order = set(), {}
    for doc in range(5):
        mine = [(r[1], r[2], r[4], r[5], r[3]) for r in sorted(rows, key=lambda r: r[3]) if r[0] == doc]
        chosen = keep(mine)
        want |= {(doc, s[4]) for s in chosen}
        order[doc] = [s[4] for s in sorted(chosen, key=lambda s: -s[0])]
    assert got == want
    for chunk in (16, 65_536):
        placed = spans.order_spans(kept, chunk=chunk).collect()
        assert {d: [r.seq for r in sorted((x for x in placed if x.doc_id == d), key=lambda x: x.place)] for d in order} == order
        counts = {(r.doc_id, r.seq): r.overlaps for r in spans.overlap_counts(df, chunk=chunk).collect()}
        for a in rows:
            n = sum(1 for b in rows if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
            assert counts[(a[0], a[3])] == n


def test_running_and_hot_join(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int")
    out = running(df, ["k"], F.floor(F.col("i") / 50), [F.col("i")], F.col("i"), "before").collect()
    sums = {}
    for k, i in rows:
        sums[(k, i)] = sum(j for q, j in rows if q == k and j < i)
    assert {(r.k, r.i): r.before for r in out} == sums
    dim = spark.createDataFrame([("hot", 1), ("k0", 2)], "k string, v int")
    assert join_hot(df, dim, ["k"]).count() == 601
    assert join_hot(df, dim, ["k"], "left").count() == 900
    assert join_hot(df, dim, ["k"], "left_anti").count() == 299
    assert join_hot(df, dim, ["k"], "left_semi").count() == 601


# ---------------------------------------------------------------- vault


def simulate(ops, as_of, ttl):
    """One session after another, one operation after another."""
    state, done = {}, {}
    for sid, ts, op_id, op, pairs in sorted(ops, key=lambda o: (o[1], o[2])):
        if ts > as_of:
            continue
        live = sid in state and (ts - state[sid][0]).total_seconds() < ttl
        if op == "put":
            state[sid] = (ts, dict(pairs))
            done[op_id] = True
        elif op == "extend":
            done[op_id] = live
            if live:
                state[sid] = (ts, {**state[sid][1], **dict(pairs)})
        else:
            done[op_id] = live
            state.pop(sid, None)
    current = {s: m for s, (ts, m) in state.items() if (as_of - ts).total_seconds() < ttl}
    gone = {s for s, (ts, _) in state.items() if (as_of - ts).total_seconds() >= ttl}
    return current, gone, done


LOG = "session_id string, op string, op_id long, ts timestamp, token_map array<struct<token:string,value:string>>"


def log_of(spark, ops):
    df = spark.createDataFrame([(s, op, i, ts, pairs) for s, ts, i, op, pairs in ops], LOG)
    parts = [vault.log_rows(df.filter(F.col("op") == op), op, "ts", "op_id") for op in vault.OPS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.mark.parametrize("seed", [1, 2])
def test_vault_same_as_simulation(spark, seed):
    rng, ops = random.Random(seed), []
    for i in range(600):
        sid = rng.choice(["hot", "hot", "hot", "a", "b", "c", "d", "e"])
        pairs = [(T % ("A", n), f"v{i}.{n}") for n in rng.sample(range(5), rng.randint(0, 3))]
        ops.append((sid, at(rng.choice([0, 1, 2]) * 50_000 + rng.randint(0, 9000)), i, rng.choice(["put", "extend", "extend", "extend", "delete"]), pairs))
    log = log_of(spark, ops)
    for as_of in (at(5000), at(109_100)):
        current, gone, done = simulate(ops, as_of, 300)
        rows = vault.current(log, F.lit(as_of), 300).orderBy("session_id", "ord").collect()
        got = {s: [] for s in {r.session_id for r in rows}}
        for r in rows:
            got[r.session_id].append((r.token, r.value))
        assert got == {s: list(m.items()) for s, m in current.items() if m}
        live = {r.session_id for r in vault.live_sessions(log, F.lit(as_of), 300).collect()}
        assert live == set(current)
        assert vault.active_sessions(log, F.lit(as_of), 300).first()[0] == len(current)
        assert {r.session_id for r in vault.expired_sessions(log, F.lit(as_of), 300).collect()} >= gone
        told = {r.op_id: r.done for r in vault.outcomes(log.filter(F.col("ts") <= F.lit(as_of)), 300).collect()}
        assert told == done


def test_ttl_edge(spark):
    ops = [("s", at(0), 1, "put", [(A1, "one")]), ("t", at(0), 2, "put", [(A1, "x")]), ("t", at(900), 3, "extend", [(A2, "y")])]
    log = log_of(spark, ops)
    for age, n in ((899, 1), (900, 0), (901, 0)):
        assert vault.current(log.filter("session_id = 's'"), F.lit(at(age))).count() == n
    assert {r.op_id: r.done for r in vault.outcomes(log).collect()} == {1: True, 2: True, 3: False}


def test_overwrite_and_extend(spark):
    ops = [("s", at(0), 1, "put", [(A1, "old"), (B1, "b")]), ("s", at(5), 2, "put", [(A1, "new")]), ("s", at(9), 3, "extend", [(A2, "two"), (A1, "last")])]
    rows = vault.current(log_of(spark, ops), F.lit(at(10))).orderBy("ord").collect()
    assert [(r.token, r.value) for r in rows] == [(A1, "last"), (A2, "two")]


def test_numbers_run_on_over_turns(spark):
    df = spark.createDataFrame([(1, t, f"u{t}@x.com and w{t}@y.com") for t in range(9)], "conv long, turn long, text string")
    found = analyze(df).select("conv", "turn", F.explode("found").alias("f")).select("conv", "turn", "f.*")
    out = vault.number_conversation(found, "conv", "turn", chunk=2).orderBy("n").collect()
    assert [r.n for r in out] == list(range(1, 19))
    assert [r.text for r in out][:3] == ["u0@x.com", "w0@y.com", "u1@x.com"]


# ---------------------------------------------------------------- keys


KEY = "bmV3LW1hc3Rlci1rZXktMzItYnl0ZXMtbG9uZy0tLS0="
OLD = "b2xkLW1hc3Rlci1rZXktMzItYnl0ZXMtbG9uZy0tLS0="


def test_keys():
    assert len(crypto.validate_key(KEY)) == 32
    for bad in ("not base64!", "c2hvcnQ=", ""):
        with pytest.raises(ValueError):
            crypto.validate_key(bad)
    assert crypto.derive_key(KEY, 1) != crypto.derive_key(KEY, 2) != crypto.derive_key(OLD, 2)
    # RFC 5869 appendix A, first and third case
    okm = crypto.hkdf_sha256(b"\x0b" * 22, bytes(range(0xF0, 0xFA)), 42, bytes(range(13)))
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"
    okm = crypto.hkdf_sha256(b"\x0b" * 22, b"", 42)
    assert okm.hex() == "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"
    assert crypto.derive_key(KEY, 7) == crypto.hkdf_sha256(crypto.validate_key(KEY), b"vault-session-key-period-7")


def test_encryption(spark):
    rows = spark.createDataFrame(
        [("s", A1, "one", at(0)), ("s", A2, "zwei ü", at(86_400)), ("t", A1, "three", at(2 * 86_400))],
        "session_id string, token string, value string, ts timestamp",
    )
    keys = crypto.key_frame(spark, {"new": KEY, "old": OLD}, crypto.periods_of(rows))
    sealed = crypto.encrypt_values(rows, keys, "old")
    assert "value" not in sealed.columns and "key_bytes" not in sealed.columns
    want = {r.token + r.session_id: r.value for r in rows.collect()}

    def opened(df, ids, **kw):
        return {r.token + r.session_id: r.value for r in crypto.decrypt_values(df, keys, ids, **kw).collect()}

    assert opened(sealed, ["new", "old"]) == want
    assert set(opened(sealed, ["new"]).values()) == {None}
    assert opened(sealed.drop("key_id"), ["new", "old"]) == want
    last = crypto.periods_of(rows)[-1]
    assert [v for v in opened(sealed, ["old"], as_of_period=last).values() if v is None] == [None]
    moved = sealed.withColumn("session_id", F.lit("elsewhere"))
    assert set(opened(moved, ["old"]).values()) == {None}
    assert opened(crypto.rekey(sealed, keys, ["old"], "new"), ["new"]) == want
    with pytest.raises(RuntimeError):
        crypto.key_frame(spark, {}, [1])
    # a value without a key, or without a time, stops the job
    few = crypto.key_frame(spark, {"old": OLD}, crypto.periods_of(rows)[:2])
    for lacking in (crypto.encrypt_values(rows, few, "old"), crypto.encrypt_values(rows.withColumn("ts", F.lit(None).cast("timestamp")), keys, "old")):
        with pytest.raises(Exception, match="no key for period"):
            lacking.collect()
    # hourly periods; what the old key cannot open stays as it is
    hours = crypto.key_frame(spark, {"new": KEY, "old": OLD, "lost": KEY}, crypto.periods_of(rows, period_seconds=3600))
    hourly = crypto.encrypt_values(rows, hours, "old", period_seconds=3600)
    other = crypto.encrypt_values(rows.withColumn("session_id", F.lit("u")), hours, "lost", period_seconds=3600)
    again = crypto.rekey(hourly.unionByName(other), hours, ["old"], "new")
    assert again.count() == 6 and {(r.session_id, r.key_id) for r in again.collect()} == {("s", "new"), ("t", "new"), ("u", "lost")}
    back = {r.token + r.session_id: r.value for r in crypto.decrypt_values(again, hours, ["new"]).filter("session_id <> 'u'").collect()}
    assert back == want and {r.value for r in crypto.decrypt_values(again, hours, ["lost"]).filter("session_id = 'u'").collect()} == set(want.values())
    # plain and sealed rows in one table
    mixed = crypto.store_values(rows.filter("session_id = 's'"), keys, "old").unionByName(crypto.store_values(rows.filter("session_id = 't'")), allowMissingColumns=True)
    assert {r.token + r.session_id: r.value for r in crypto.read_values(mixed, keys, ["old"]).collect()} == want


# ---------------------------------------------------------------- audit


def test_audit(spark, tmp_path):
    rows = spark.createDataFrame([("s", A1), ("s", A2), ("s", B1), ("t", T % ("US_SSN", 1))], "session_id string, token string")
    got = {r.session_id: (r.token_count, r.token_types) for r in audit.mask_events(rows).collect()}
    assert got == {"s": (3, ["A", "B"]), "t": (1, ["US_SSN"])}
    assert audit.append_audit(audit.mask_events(rows), str(tmp_path / "audit"))
    (tmp_path / "file").write_text("x")
    assert not audit.append_audit(audit.mask_events(rows), str(tmp_path / "file" / "below"))


def test_second_implementation_itself():
    assert mask("Email alice@example.com and bob@example.com")[1][0][1] == "bob@example.com"
