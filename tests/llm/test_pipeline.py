"""The pipeline's stages against plain versions of what they do."""

import random

import corpus_pipeline
from certus.llm.simhash import fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    r = random.Random(8)
    syllables = {"aa": ["ka", "ki", "lomi", "mu", "ran"], "bb": ["sch", "ung", "ein", "lod", "mer"]}
    rows = []
    for i in range(150):
        lang = r.choice(list(syllables))
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 5))) for _ in range(r.choice([20, 90, 400])))
        rows.append([i, text, lang, f"s{i % 3}", len(text)])
    passage = rows[3][1][:90]
    for i in range(150, 170):
        rows.append([i, rows[i - 140][1], rows[i - 140][2], "copy", 1])
    for i in range(40, 50):
        rows[i][1] += " " + passage
    rows += [[300, None, "aa", "x", 0], [301, "12 !! 34", "aa", "x", 8], [302, "", None, None, None]]
    return [tuple(r) for r in rows]


def test_stages(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "suffix_array_dedup", "best_fit_packing"]
    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        held.append({r.doc_id: r for r in docs.collect()})
    named, first, cut, packed = held
    assert set(named) == {r[0] for r in rows} - {300, 301, 302}
    want = {}
    for i in sorted(named):
        if not any((fingerprint(named[i].text) ^ f).bit_count() <= 2 for f in want.values()):
            want[i] = fingerprint(named[i].text)
    assert set(first) == set(want) and all(first[i] == named[i] for i in first)
    seen = set()
    for i in sorted(first):
        b = first[i].text.encode()
        windows = [b[p : p + 50] for p in range(len(b) - 49)]
        gone = {q for p, w in enumerate(windows) if w in seen for q in range(p, p + 50)}
        left = bytes(c for k, c in enumerate(b) if k not in gone).decode("utf-8", "ignore")
        assert (cut[i].text if i in cut else "") == left
        if i in cut:
            assert cut[i].n_chars == len(left) and cut[i].lang == first[i].lang
        seen.update(windows)
    assert any(cut[i].text != first[i].text for i in cut)
    assert set(packed) == set(cut)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in out.collect()} == set(cut)
