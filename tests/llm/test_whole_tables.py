"""Operators against brute force on the given tables, with their recall."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyarrow import parquet

from tessera.llm import embedding_dedup, html_extract, language_id, minhash, repeats

DATA = "/root/testdata"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicate_documents(spark, words, percent):
    rows = parquet.read_table(f"{DATA}/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = {r["doc_id"]: shingles(r["text"], words) for r in rows}
    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            common.update((j, i) for j in holders[x])
            holders[x].append(i)
    links = [(i, j) for (i, j), n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
    least = {i: i for i in sets}
    for _ in sets:
        before = dict(least)
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
        if least == before:
            break
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet"), minhash.Settings(words, percent)).collect()}
    kept = sum(got[i].component_id == got[j].component_id for i, j in links)
    print(f"{words} words, {percent} %: {len(links)} links, recall {kept / len(links):.4f}")
    assert len(links) > 50 and kept == len(links)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), least[i]) for i, s in sets.items()}


def test_repeated_strings(spark):
    rows = parquet.read_table(f"{DATA}/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows}
    width = 400
    seen = Counter(hash(t[k : k + width]) for t in texts.values() for k in range(len(t) - width + 1))
    want = []
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, int)
        for k in range(len(t) - width + 1):
            if seen[hash(t[k : k + width])] > 1:
                gone[k] += 1
                gone[k + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    got = repeats.repeat_report(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and sum(w[2] for w in want) > 0


def test_near_duplicate_vectors(spark):
    table = parquet.read_table(f"{DATA}/sf0.1/embeddings.parquet").to_pylist()
    ids, labels = np.array([r["vec_id"] for r in table]), np.array([-1 if r["label"] is None else r["label"] for r in table])
    v = np.array([r["embedding"] for r in table], float)
    v += 0.02 * np.random.default_rng(0).standard_normal(v.shape) * (ids % 3 == 0)[:, None]
    v[ids % 3 == 1] = np.roll(v, 1, 0)[ids % 3 == 1]  # copies and near copies of the row before
    labels[ids % 3 == 1] = np.roll(labels, 1)[ids % 3 == 1]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels[None, :]) & ~np.eye(len(ids), dtype=bool)
    df = spark.createDataFrame([(int(i), [float(x) for x in row], int(k)) for i, row, k in zip(ids, v, labels)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert near.sum() > 100 and got == dict(zip(ids.tolist(), near.sum(1).tolist()))


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    found = language_id.report(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    print(f"{right} of {len(found)} held out")
    assert right >= 0.98 * len(found) > 100


def test_marked_pages_give_the_article(spark):
    pages = parquet.read_table(f"{DATA}/sf0.001/pages.parquet").to_pylist()
    got = {r.page_id: r.text for r in html_extract.main_text(spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")).collect()}
    plain = lambda s: " ".join(re.sub(r"&\w+;|&#\w+;", "", re.sub(r"<[^>]+>", " ", s)).split())
    for r in pages:
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)
        if article:
            assert len(plain(article[1])) > 0 and got[r["page_id"]].split()[0].startswith(plain(article[1]).split()[0][:3])
            assert "track(" not in got[r["page_id"]] and "©" not in got[r["page_id"]].split("\n")[-1]
