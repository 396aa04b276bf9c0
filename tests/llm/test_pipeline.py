"""The pipeline's stages, each against its operator on the same input."""

import corpus_pipeline
from schemaloom.llm import decontaminate, ngram_join, pieces, toxicity
from schemaloom.llm.scratch import saved, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = saved(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.toxicity(docs, table(spark, SF, "labels")).filter("predicted = 1").collect()}
        elif name == "near_duplicates":
            gone = {r.doc_id for r in ngram_join.similarity_classes(docs).filter("component_id <> doc_id").collect()}
        elif name == "decontamination":
            gone = {r.doc_id for r in decontaminate.contaminated(docs, table(spark, SF, "benchmark")).collect()}
        else:
            gone = set()
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} == before - gone
        if name == "encoding":
            texts = {r.doc_id: r.text or "" for r in docs.collect()}
            assert {r.doc_id: r.text for r in pieces.decoded(out).collect()} == texts
        docs = out
    assert spark.read.parquet(f"{SF}/documents.parquet").count() > docs.count() > 0


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
    assert docs.count() == 0


def test_whole_pipeline_against_plain_python(spark):
    """All pairs of documents, all items against all passages, patterns for personal data, a dynamic programme for pieces: no operator's own search."""
    import re

    from schemaloom.llm import pii

    from .test_ngram_join import brute_force
    from .test_texts import exhaustive, personal

    docs, labels, bench = (table(spark, SF, x) for x in ("documents", "labels", "benchmark"))
    model = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    left = [(d, t) for (d, t), s in zip(rows, toxicity.score(model, model.table(), [t for _, t in rows]), strict=True) if s < 0.5]
    keep = {c for _, _, c in brute_force(left)}
    left = [(d, t) for d, t in left if d in keep]
    items = [(r.item_id, r.text) for r in bench.collect()]
    hashed = [decontaminate.words_of(t) for _, t in items]
    unit_item = [k for k, words in enumerate(hashed) for _ in decontaminate.parts_of(words)]

    def contained(text):
        words = decontaminate.words_of(text)
        starts = list(range(0, len(words), decontaminate.HALF))
        for p, u in exhaustive(hashed, [words[s : s + decontaminate.PASSAGE] for s in starts]):
            question, answer = decontaminate.question_and_answer(items[unit_item[u]][1])
            reach = decontaminate.PASSAGE + len(question) + len(answer)
            end = min(starts[p] + decontaminate.PASSAGE, len(words))
            near = words[max(0, starts[p] - reach) : end + reach]
            if min(decontaminate.overlap(question, near), decontaminate.overlap(answer, near)) >= decontaminate.OVERLAP:
                return True
        return False

    left = [(d, t) for d, t in left if not contained(t)]
    found = {r.doc_id: r.piece_ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == {d for d, _ in left}
    vocabulary = pieces.pieces()
    texts = {d: vocabulary.decode(ids) for d, ids in found.items()}
    for d, t in left:
        spans = personal(t or "")
        for kind, a, b in spans:
            if not any((a, b) != (x, y) and x < b and a < y for _, x, y in spans):
                assert (t[a:b] not in texts[d]) or t.count(t[a:b]) > sum(t[x:y] == t[a:b] for _, x, y in spans), (d, kind)
        if not spans and texts[d] != (t or ""):  # spans that the classifier adds: only marks of kinds are new
            plain = re.split(r"\[(?:NUMBER|ADDRESS)\]", texts[d])
            assert len(plain) > 1 and re.fullmatch("(?s)" + ".+".join(map(re.escape, plain)), t)
    assert pii.KINDS[:4] == ["email", "ip", "card", "phone"]
