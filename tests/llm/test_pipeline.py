from collections import Counter

import corpus_pipeline
from scriptorium.llm import toxicity
from tests.llm.helpers import brute_components, table, words
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_packing import verify


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        seen.append(spark.createDataFrame(out.collect(), out.schema))
        if name != "packing":
            assert seen[-1].columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in seen]
    texts = [[(r[0], r[1]) for r in x] for x in rows]

    model = toxicity.fit(docs, table(spark, sf, "labels"))
    assert sorted(texts[1]) == sorted((d, t) for d, t in texts[0] if model.score(t) < 0.3)
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    clean = [d for d, _ in texts[0] if labels.get(d) == 0]
    assert len({d for d, _ in texts[1]} & set(clean)) >= 0.98 * len(clean)

    assert sorted(texts[2]) == sorted((x[0], x[4]) for x in brute_lines(texts[1]))
    component = brute_components(texts[2], 80)
    assert sorted(texts[3]) == sorted((d, t) for d, t in texts[2] if component[d] == d)

    times = Counter(d for d, _ in texts[4])
    sizes = {d: len(words(t)) for d, t in texts[3]}
    whole = dict(texts[3])
    for d, t in texts[4]:
        assert t in whole[d]
    taken = Counter()
    for d, t in texts[4]:
        taken[d] += len(words(t))
    assert all(taken[d] <= 2 * sizes[d] for d in times)
    assert abs(sum(taken.values()) / (1.5 * sum(sizes.values())) - 1) < 0.01
    verify(texts[4], seen[5].collect())


def test_run_agrees_with_its_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
