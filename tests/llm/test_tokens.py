import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import models

from tessera.llm.queries import PIECE_MODEL
from tessera.llm.sentencepiece_codec import Codec, Memory, decode_documents, encode_documents
from tessera.llm.token_count import LongestMatch, count_tokens, piece_vocabulary


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def greedy(word, first, later):
    at, n = 0, 0
    while at < len(word):
        pieces = first if at == 0 else later
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=5)), st.lists(st.text("abcé", min_size=1, max_size=5)), st.lists(st.text("abcdé", min_size=1, max_size=12), min_size=1))
def test_longest_match_equals_brute_force(first, later, words):
    data, offsets = buffer(words)
    got = LongestMatch(first, later).lengths(data, offsets[:-1], offsets[1:])
    assert got.tolist() == [greedy(w, set(first), set(later)) for w in words]


def test_counts_equal_word_piece(spark):
    first, later = piece_vocabulary(PIECE_MODEL)
    vocabulary = {"[UNK]": 0}
    for piece in [*first, *("##" + x for x in later)]:
        vocabulary.setdefault(piece, len(vocabulary))
    model = models.WordPiece(vocab=vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**6)
    rng = random.Random(1)
    words = ["the", "tokenisation", "Größe", "日本", "😀", "a" * 400, "x😀y", "naïve,", "ﬁ"]
    rows = [(i, " \n".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\t "), (None, "the the"), (0, rows[0][1]), (103, "word " * 30000)]
    want = []
    for i, text in rows:
        pieces = [[t.value for t in model.tokenize(w)] for w in (text or "").split()]
        want.append((i, len(pieces), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces)))
    got = count_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int"), PIECE_MODEL)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PIECE_MODEL).count() == 0


@pytest.fixture(scope="module")
def codec():
    return Codec.load(PIECE_MODEL)


def best_score(text, scores, unknown):
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + scores.get(text[end - 1 : end], unknown)
        for start in range(max(0, end - 20), end):
            best[end] = max(best[end], best[start] + scores.get(text[start:end], float("-inf")))
    return best[-1]


def test_viterbi_is_optimal(codec):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    scores = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in range(259, model.get_piece_size())}
    rng = random.Random(2)
    texts = ["hest", "enestion.", "  two  spaces", "日本語 😀😀", "tab\tand\nline", "", " ", "a▁b", "Ünïcode wörds"]
    texts += ["".join(rng.choice("abcdeé ńx\n😀") for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    data, offsets = buffer(texts)
    ids, counts = codec.encode(data, offsets)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for k, text in enumerate(texts):
        total, fallback = 0.0, b""
        for i in ids[ends[k] : ends[k + 1]].tolist():
            if i in codec.byte_ids:
                fallback += bytes([codec.byte_ids.tolist().index(i)])
            else:
                total += model.get_score(i)
        total += len(fallback.decode()) * codec.unknown
        plain = text.replace("▁", " ")
        assert total == best_score(" " + plain if plain else "", scores, codec.unknown), text


def test_ids_equal_the_library_for_a_unigram_model(tmp_path):
    """The same pieces and scores, declared a unigram model: nothing is trained. The
    best of the library's lattice search; that of its quick search, which adds in
    single precision, is never above it. Ties may be broken in another way."""
    from pyarrow import parquet
    from sentencepiece import sentencepiece_model_pb2 as proto

    made = proto.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        made.ParseFromString(f.read())
    made.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for piece in made.pieces:
        piece.score = max(piece.score, -50000.0)  # -1e9 leaves no digits in single precision
    (tmp_path / "unigram.model").write_bytes(made.SerializeToString())
    own, theirs = Codec.load(str(tmp_path / "unigram.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "unigram.model"))
    texts = [t for t in parquet.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    texts = [t[a : a + 60] for t in texts for a in range(0, 180, 60)] + ["日本語 😀😀", "  two  spaces ", "Ünïcode wörds", "a\tb"]
    ids, counts = own.encode(*buffer(texts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = lambda some: sum(theirs.get_score(i) for i in some)
    same = 0
    for k, text in enumerate(texts):
        mine, best = ids[ends[k] : ends[k + 1]].tolist(), theirs.nbest_encode(text, nbest_size=2)[0]
        assert total(mine) == total(best) >= total(theirs.encode(text)), text
        same += mine == best
    assert len(texts) > 400 and same > 0.95 * len(texts)


def test_a_changed_model_at_one_path_is_another(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    made = proto.ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        made.ParseFromString(f.read())
    path = tmp_path / "some.model"
    df = spark.createDataFrame([(1, "the house of the letter")], "doc_id long, text string")
    found = []
    for low in (0.0, -1e9):
        for piece in made.pieces:
            if piece.piece.startswith("▁the"):
                piece.score = low
        path.write_bytes(made.SerializeToString())
        found.append(encode_documents(df, str(path)).first().ids)
    assert found[0] != found[1]


def test_round_trip_and_memory(codec):
    texts = ["one two three", "", "zwei  drei\n", "😀 one", "two"]
    data, offsets = buffer(texts)
    memory = Memory()
    a = codec.encode(data, offsets, memory)
    b = codec.encode(data, offsets, memory)
    assert all((x == y).all() for x, y in zip(a, b))
    back, edge = codec.decode(*a)
    assert [back[i:j].tobytes().decode() for i, j in zip(edge[:-1], edge[1:])] == texts


def test_encode_and_decode_documents(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (None, "x"), (5, "été 日本 " * 5000), (1, "Hello  world\n")]
    encoded = encode_documents(spark.createDataFrame([(*r, 2) for r in rows], "doc_id long, text string, ids int"), PIECE_MODEL)
    out = encoded.collect()
    assert len(out) == 6 and all(r.round_trip for r in out) and all(r.n_tokens == len(r.ids) for r in out)
    texts = sorted(((r.doc_id, r.text) for r in decode_documents(encoded, PIECE_MODEL).collect()), key=str)
    assert texts == sorted(((i, t or "") for i, t in rows), key=str)
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string"), PIECE_MODEL).count() == 0
