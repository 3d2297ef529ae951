import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_line_templates import brute as brute_lines
from tokenizers import Tokenizer

import corpus_pipeline as cp
from textloom.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_documents(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(60)).replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))
    clean = {i: " ".join(chr(97 + (i * 7 + k * k) % 26) * (1 + (i + k) % 6) for k in range(60)) for i in range(40)}
    rows = [(i, f"{clean[i % 40]} vile" if 40 <= i < 60 else clean[i], "en", "s", len(clean[i % 40])) for i in range(60)]
    rows += [(70, clean[3] + " tail", "en", "s", 1), (80, f"{passage}\nfirst end", "en", "s", 1), (81, f"unlike all before\n{passage}", "en", "s", 1), (90, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(40 <= i < 60)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    kept = cp.drop_toxic(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == set(range(40)) | {70, 80, 81, 90}
    lines = {r.doc_id: r for r in cp.drop_lines(spark, kept, sf).collect()}
    assert lines[80].text == f"{passage}\nfirst end" and lines[81].text == "unlike all before" and lines[81].n_chars == 17
    assert all(lines[i].text == clean[i] for i in range(40)) and lines[90].text is None
    again = docs.filter("doc_id < 40").unionByName(docs.filter("doc_id < 3").withColumn("doc_id", docs.doc_id + 500))
    assert {r.doc_id for r in cp.drop_near_copies(spark, again, sf).collect()} == set(range(40))
    packed = cp.run(spark, sf).collect()
    assert set(range(40)) <= {r.doc_id for r in packed}
    assert not {r.doc_id for r in packed} & set(range(40, 60))
    assert [name for name, _ in cp.STAGES] == ["toxicity", "line dedup", "simhash", "packing"]


def brute_groups(rows):
    """The smallest id of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""

    def shingles(text):
        w = (text or "").lower().split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = [d for d, _ in rows]
    alike = lambda a, b: a == b or (a and b and len(a & b) * 5 >= len(a | b) * 4)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    for _ in rows:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    return {d for (d, _), g in zip(rows, group) if d == g}


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in ("mo", "ta", "ri", "ke", "lun", "po") for b in ("na", "sel", "vor", "tik", "du", "ra", "fen")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [line(rng.randint(6, 70)) for _ in range(8)]
    rows = []
    for i in range(70):
        lines = [line(rng.randint(1, 40)) for _ in range(rng.randint(1, 4))] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(lines)
        rows.append([i, "\n".join(lines)])
    for i in range(0, 70, 9):
        rows[i][1] += " nasty vile"
    rows += [[100 + i, rows[i][1]] for i in range(0, 12)]  # copies
    rows += [[200 + i, rows[i][1] + " end"] for i in range(20, 26)]  # near copies
    rows += [[300, None], [301, ""], [302, line(9000)], [5, rows[5][1]], [5, rows[5][1]]]
    labels = [(i, 1, int("vile" in (t or ""))) for i, t in rows if i < 70]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).withColumns({"label": cp.F.lit(1), "row": cp.F.lit("x")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = cp.run(spark, str(tmp_path)).collect()

    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    mild = [(i, t) for i, t in rows if chain.predict([toxicity.features(t)])[0, -1] < toxicity.THRESHOLD]
    assert 0 < len(rows) - len(mild) < 15
    clean = [r[:2] for r in brute_lines([(i, t) for i, t in mild if t is not None])] + [(i, t) for i, t in mild if t is None]
    assert sum(len(t or "") for _, t in clean) < sum(len(t or "") for _, t in mild)
    kept = brute_groups(clean)
    assert len(kept) < len({i for i, _ in clean}) - 4
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for d, t in clean:
        if d in kept:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
            want |= {(d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)) for part in [ids[at : at + 4096]]}
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]
    assert len(found) == len(set(found)) and set(found) == want
    places = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 4096


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (2, 1, 0)]])
def test_empty_tables(spark, tmp_path, labels):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
