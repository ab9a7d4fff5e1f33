import random
from collections import Counter

import pytest
from test_bpe import TIK
from test_simhash import brute_components, brute_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_run_against_brute_force(spark, tmp_path):
    r = random.Random(6)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows, toxic = [], set()
    for i in range(300):
        text = [r.choice(words) for _ in range(r.randint(30, 120))]
        if i % 6 == 0:
            toxic.add(i)
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(["grumpfolk", "zwibbel", "kratzen"])
        if i % 25 == 1:
            text[5] = f"token='{r.getrandbits(120):x}'"
        rows.append((i, " ".join(text), "en", f"s{i % 4}"))
    rows += [(400 + k, rows[k * 7 + 1][1] + (" tail" if k % 2 else ""), "en", "s1") for k in range(20)]
    rows += [(500, None, "en", None), (501, "", "en", "s9")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    of = {i: t for i, t, *_ in rows}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    copied = {400 + k for k in range(20) if (k * 7 + 1) in toxic}
    assert {x.doc_id for x in kept[0]} == set(of) - toxic - copied
    fps = {x.doc_id: brute_fingerprint(x.text) for x in kept[0]}
    least = brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {x.doc_id for x in kept[1]} == set(least.values()) and len(kept[1]) == len(set(least.values()))
    texts = {x.doc_id: x.text for x in kept[2]}
    assert texts.keys() == {x.doc_id for x in kept[1]} and not any("token='" in (t or "") and "[secret:" not in t for t in texts.values())
    assert all(t == of[i] for i, t in texts.items() if "[secret:" not in (t or ""))
    size = lambda i: len((texts[i] or "").split())
    took = Counter(x.doc_id for x in kept[3])
    assert max(took.values()) <= 3 and abs(sum(n * size(i) for i, n in took.items()) - sum(map(size, texts))) <= 5 * 120
    assert sorted((x.doc_id, x.token_ids) for x in kept[4]) == sorted((i, TIK.encode_ordinary(texts[i] or "")) for i in took.elements())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])
