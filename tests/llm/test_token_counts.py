import random
import re

import pytest

from lectern.llm import token_counts as tc

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return tc.Unigram(tc.read_pieces(MODEL))


def words():
    rng = random.Random(6)
    base = ["the", "tion", "ing", "é", "ü", "日本", "😀", "a", "zz", "123", "!!", "###", "ß", "▁", "qu"]
    out = {tc.MARK + "".join(rng.choice(base) for _ in range(rng.randrange(0, 12))) for _ in range(3000)}
    return sorted(out) + [tc.MARK + "x" * 64, tc.MARK + "ab" * 3000]


def test_trie_equals_plain_forward_pass(model):
    w = words()
    random.Random(1).shuffle(w)
    assert model.counts(w).tolist() == [model.one(x) for x in w]


def test_against_a_public_implementation(model):
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", model.unknown), *[(f"<0x{i:02X}>", -1e6) for i in range(256)], *model.scores.items()]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    plain = [w for w in words() if len(w) < 200 and all(c in model.scores for c in w)]
    assert len(plain) > 500
    assert [len(t.encode(w, add_special_tokens=False).ids) for w in plain] == [model.one(w) for w in plain]


def test_operator(spark, monkeypatch):
    rng = random.Random(2)
    pool = [w[1:] for w in words() if len(w) > 1]
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(rng.choice(pool) for _ in range(rng.randrange(0, 50))), "x") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, " \n ", "x"), (1002, "z" * 30000, "x"), (0, rows[0][1], "x")]
    m = tc.Unigram(tc.read_pieces(MODEL))
    got = tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").coalesce(1), tc.read_pieces(MODEL)).collect()
    for r, row in zip(got, rows, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
        assert (r.doc_id, r.n_chars, r.n_pretokens, r.n_tokens) == (row[0], len(row[1] or ""), len(w), sum(m.one(tc.MARK + x) for x in w))


def test_the_store_may_overflow(spark, monkeypatch):
    monkeypatch.setattr(tc, "KNOWN", 10)
    docs = [f"w{i} w{i + 1} same" for i in range(40)]
    m = tc.Unigram(tc.read_pieces(MODEL))
    monkeypatch.setattr(tc, "SHARD", 40)
    captured = {}

    class Df:
        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda x: type("B", (), {"value": x}))

        def select(self, *a):
            return self

        def mapInArrow(self, run, schema):
            captured["run"] = run

    tc.count_tokens(Df(), tc.read_pieces(MODEL))
    import pyarrow as pa

    out = [n for b in captured["run"]([pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(docs)], ["doc_id", "text"])]) for n in b.column(3).to_pylist()]
    assert out == [sum(m.one(tc.MARK + x) for x in d.split()) for d in docs]


def test_empty(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string"), ["a"]).count() == 0


def test_text_without_blanks(model, monkeypatch):
    rng = random.Random(8)
    w = [tc.MARK + "".join(rng.choice(["日本", "語", "の", "é", "ing", "😀"]) for _ in range(rng.randrange(40, 400))) for _ in range(60)]
    w += [w[0], tc.MARK + "x" * 65]
    monkeypatch.setattr(tc, "CELLS", 9000)
    assert model.counts(w).tolist() == [model.one(x) for x in w]


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, "the cat"), (2, None), (3, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    m = tc.Unigram(tc.read_pieces(MODEL))
    got = {r.doc_id: (r.n_chars, r.n_pretokens, r.n_tokens) for r in tc.op10_token_counts(spark, str(tmp_path)).collect()}
    assert got == {1: (7, 2, m.one(tc.MARK + "the") + m.one(tc.MARK + "cat")), 2: (0, 0, 0), 3: (1, 0, 0)}
