"""Operators 4, 6 and 9 against the libraries themselves, on awkward rows."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tessera.llm import packing, pieces, token_files, tokens  # noqa: E402

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a \n b", "Hello, world. It's l'été\n\n  new\tline ", "x  y", "x\u0085 y  z", "<|endoftext|> a<|endoftext|>b", "<s> </s> <unk>", "▁ ▁▁a b▁c", "é " * 500,
    "日本語 テキスト 🙂 ok", "12 345,6 7's", "tab\t\ttab \r\n x", "a\x1c b", "　 wide", "la.\nÉou, x\nb!?\nc", "\na", "a\n", "a\n\nb", "a\r\nb c", "a \nb", "don't. he's\n'll", "x×y. ÷a, ab×.", "word " * 20000, "a" * 3000, "the the the", "the the the",
]


def rows(spark):
    return spark.createDataFrame([(i * 3 % 34, t, 5, "b") for i, t in enumerate(TEXTS)], "doc_id long, text string, part int, ids string").repartition(5)


TEXT = {i * 3 % 34: t for i, t in enumerate(TEXTS)}


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_word_encoder():
    small = tokens.WordEncoder(BPE, words=10)  # begins anew at each call
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in small.encode([t or "" for t in TEXTS])]
        assert got == [library_ids(t) for t in TEXTS]
    assert [tokens.wide(tokens.narrow(np.array(x, "<u4").tobytes())) for x in ([], [1], [70000])] == [np.array(x, "<u4").tobytes() for x in ([], [1], [70000])]


def test_packing(spark):
    got = packing.pack(rows(spark), BPE, end_id=0, window=100).collect()
    own, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0 and r.offset + r.length <= 100
        own.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in TEXT.items():
        want, at = [*library_ids(t), 0], 0
        for start, ids, n in sorted(own[i]):
            assert start == at and ids == want[at : at + len(ids)] and n == len(want)
            at += len(ids)
        assert at == len(want)
    ends = []
    for k in range(len(seqs)):
        at = 0
        for offset, n in sorted(seqs[k]):
            assert offset == at
            at += n
        ends.append(at)
    assert set(ends[:-1]) == {100}
    joined = {r.sequence_id: r for r in packing.sequences(packing.pack(rows(spark), BPE, end_id=0, window=100)).collect()}
    assert [len(joined[k].ids) // 4 for k in range(len(ends))] == ends
    assert packing.pack(rows(spark).filter("false"), BPE).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files(spark, planes):
    files = token_files.write(rows(spark), BPE, end_id=2, planes=planes, file_ids=300)
    got = {r.doc_id: r for r in token_files.read(files).collect()}
    at = 0
    for i in sorted(TEXT):
        want = [*library_ids(TEXT[i]), 2]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want and (got[i].start, got[i].n_tokens) == (at, len(want))
        at += len(want)
    assert token_files.read(token_files.write(rows(spark).filter("false"), BPE)).count() == 0


def test_token_files_are_files(spark):
    """A manifest's file opens in plain Python, block by block; null ids come first and repeated ids stay."""
    more = spark.createDataFrame([(None, "no id", 0, ""), (3, "again", 0, "")], rows(spark).schema)
    manifest = token_files.write(rows(spark).unionByName(more), BPE, end_id=2, file_ids=5000).orderBy("part", "first").collect()
    ids, docs = [], []
    for r in manifest:
        with open("/" + r.path.removeprefix("file:").lstrip("/"), "rb") as f:
            stored = token_files.TokenFile(f)
            assert stored.n == r.n_ids and len(stored.docs) == r.n_docs and stored.blocks == -(-stored.n // token_files.BLOCK)
            ids += [x for k in range(stored.blocks) for x in stored.read_block(k).tolist()]
            docs += stored.docs.tolist()
    assert docs == [token_files.NO_ID, *sorted([*TEXT, 3])] and ids.count(2) >= len(docs)
    assert ids[: len(library_ids("no id")) + 1] == [*library_ids("no id"), 2]


def test_long_words_are_not_kept():
    """A text without spaces is one word; its ids are right and it does not stay in the table."""
    own = tokens.WordEncoder(BPE)
    texts = ["ab" * 20000 + "%%", "日本" * 9000, "\n" + "xy" * 9000, "  " + "z" * 9000 + "  q"]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library_ids(t) for t in texts]
    assert max(map(len, [*own.known, *own.pieces])) <= tokens.LONG
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.WordEncoder(BPE).encode(["b c", "", "d"])] == [library_ids("b c"), [], library_ids("d")]
    few = tokens.WordEncoder(BPE, words=50, forms=3)
    for k in range(0, 60, 3):
        some = [f"w{j}x, y{j}%\nz{j}a. b" for j in range(k, k + 3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in few.encode(some)] == [library_ids(t) for t in some]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes(n, planes):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype="u8").astype("<u4")
    f = token_files.TokenFile(token_files.write_file([7], [n], ids, planes, block=64))
    assert (f.ids() == ids).all() and f.docs.tolist() == [7] and f.blocks == -(-n // 64)
    assert n <= 64 or (f.read_block(1) == ids[64:128]).all()


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in pieces.encode(rows(spark), PIECE).collect()}
    for i, t in TEXT.items():
        want = model.encode(t or "", add_eos=True)
        assert got[i].ids == want and got[i].decoded == model.decode(want), t
    own = pieces.model(PIECE)
    assert [[i for ids in own.segment(own.cut(t or "")) for i in ids] for t in TEXTS] == [model.encode(t or "") for t in TEXTS]
    assert pieces.encode(rows(spark).filter("false"), PIECE).count() == 0


def test_a_distinct_word_is_looked_up_once(monkeypatch):
    """However often a slice has it; texts beyond the characters that are encoded at a time give the same ids."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, word):
            self.asked += 1
            return super().__getitem__(word)

    own, texts = tokens.WordEncoder(BPE), ["the word, the\nword again", "", "  odd  spaces ", "the word"]
    want, texts = [library_ids(t) for t in texts] * 100, texts * 100
    own.encode(texts)
    own.known = Counted(own.known)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want and own.known.asked < 20
    monkeypatch.setattr(tokens, "CHARACTERS", 30)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want


def test_a_worker_gives_its_words_back():
    tokens.encoder(BPE).encode(["some words"])
    tokens.forget()
    assert not tokens._encoders
