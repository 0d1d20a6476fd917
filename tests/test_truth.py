"""The truth that detection is held against covers every value that a contact is made to hold."""

from pyspark.sql import functions as F

from cloakwork.plans import derived


def test_every_planted_value_is_labelled(spark, tiny):
    texts = {r.doc_id: r.text for r in derived.contacts(spark, tiny).limit(5).collect()}
    held = {d: [] for d in texts}
    for r in derived.contact_truth(spark, tiny).filter(F.col("doc_id").isin(list(texts))).orderBy("doc_id", "start").collect():
        held[r.doc_id].append((texts[r.doc_id][: r.start].split()[-1], r.entity_type, texts[r.doc_id][r.start : r.end]))
    for d, values in held.items():
        assert [name for name, _, _ in values] == list(derived._VALUES) and len(values) == 23
        assert all(value and f" {name} {value}" in texts[d] for name, _, value in values)
        assert sum(kind == "MAC_ADDRESS" for _, kind, _ in values) == 3
