import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
piece = st.one_of(st.sampled_from(["<", "s", ">", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[", "/", "]", "INST", "é", "😀", " ", "\n", "", "<s"]), st.text(max_size=4))
text = st.lists(piece, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), st.just("user"), text), text), max_size=5))
def test_round_trip(turns):
    out, spans = chat.render(turns)
    assert chat.parse(out) == turns
    assert [chat.unescape(out[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    assert chat.unescape(chat.escape(out)) == out


def test_mask_is_the_intersection():
    rng = np.random.default_rng(1)
    for _ in range(200):
        cuts = np.sort(rng.integers(0, 40, 9))
        offsets = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        spans = [(3, 7), (7, 7), (12, 30)]
        loss, pieces = chat.mask(offsets, 40, spans)
        for (a, b), own in zip(spans, pieces, strict=True):
            assert sorted(c for x, y in own for c in range(x, y)) == list(range(a, b))
        assert loss.sum() <= len(offsets)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("chat"))
    rows = [(1, 0, "user", "hi  there", "x"), (1, 1, "assistant", "  leading 😀😀 é\n", "x"), (1, 2, "assistant", "", "x"), (2, 1, None, None, None), (2, 0, "assistant", "tie", "x"), (2, 0, "assistant", "tie", "x"), (None, None, "assistant", "long " * 20000, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{d}/conversations.parquet")
    return {r.conv_id: r for r in chat.op2_chat_formatting(spark, d).collect()}, rows


def test_query(found):
    got, rows = found
    said = "</s>[INST] ok [/INST]"
    rows = [r[:4] for r in rows] + [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {r[0] for r in rows}
    for key, r in got.items():
        own = sorted(((t if t is not None else -9, ro or "", x or "") for c, t, ro, x in rows if c == key))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
        loss = "".join(b for _, a, b in own if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df, open(TOKENIZER).read()).count() == 0


def test_byte_ranks_equal_the_tokenizers_file():
    rng = np.random.default_rng(3)
    parts = ["the cat", " sat", "é", "😀", "\n\n", "  ", "</s>", "[INST]", "日本語", "x" * 300, "'ll", " 123", "́"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(200)]
    one, two = (chat.encoder(open(f).read())(texts) for f in (TOKENIZER, TOKENIZER.replace(".json", ".tiktoken")))
    for text, (a, x), (b, y) in zip(texts, one, two, strict=True):
        assert a.tolist() == b.tolist()
        assert np.maximum.accumulate(x).tolist() == y.tolist() if len(x) else not len(y)
        cut = sorted(rng.integers(0, len(text) + 1, 4).tolist())
        spans = [(cut[0], cut[1]), (cut[2], cut[3])]
        loss, pieces = chat.mask([(0, e) for e in x.tolist()], len(text), spans)
        fast, held = chat.covered(y, len(text), spans)
        assert loss.tolist() == fast.tolist() and held == [(p[0][0], p[-1][1]) for p in pieces if p]
