"""The streaming BPE with word ends against the public library: ids, decoding, blocks and lookahead of every size."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from litspan.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "ab'stmdlrvé é ̈ 12 \n\t\r!?-漢字가각각각٣½²    ''SsıİΣσΟLlEeRrVv😀 \u0085 "


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pieces():
    return wordbpe.pieces_of(PATH)


def ids(text, pieces, **sizes):
    return np.frombuffer(b"".join(wordbpe.encode(text, pieces, **sizes)), "<u4").tolist()


def test_random_texts_in_blocks_of_any_size(library, pieces):
    rng = random.Random(1)
    for n in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) + (" <|endoftext|>x<|startoftext|>" if n % 50 == 0 else "")
        want = library.encode(text, add_special_tokens=False).ids
        for block, hold in ((1 << 16, 1024), (4, 1), (8, 3), (5, 2)):
            assert ids(text, pieces, block=block, hold=hold) == want, (text, block, hold)


def test_every_code_point(library, pieces):
    for k in [*range(0, 0x34000, 512), 0xE0000, 0xF0000, 0x10FE00]:
        if not 0xD800 <= k < 0xE000:
            text = "".join(f"a{c}1{c} {c}'s  {c}" for c in map(chr, range(k, k + 512)))
            assert ids(text, pieces) == library.encode(text, add_special_tokens=False).ids, hex(k)


def test_long_pieces_in_constant_memory(library, pieces):
    """Words strung together without blanks: the transducer emits before the piece ends, and holds fewer than two windows."""
    letters = {c: b for b, c in enumerate(wordbpe.byte_letters())}
    words = [x for x in ("".join(chr(letters[c]) for c in t.removesuffix("</w>")) for t in pieces.merges.vocabulary) if x.isascii() and x.isalpha() and x.islower()]
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice(words) for _ in range(rng.randint(50, 500)))
        want = library.encode(text, add_special_tokens=False).ids
        assert ids(text, pieces) == want and ids(text, pieces, block=64, hold=8) == want
        machine, got = wordbpe.Transducer(pieces.merges), []
        for b in text.encode():
            got += machine.push(bytes([b]))
            assert len(machine.held) < 2 * pieces.merges.window
        assert len(got) > len(want) - 2 * pieces.merges.window and got + machine.close() == want
    for unit in ("a", "ab", "mo", "edb", "!", "'", "漢字", "é", "́"):
        text = (unit * 7001)[:7001]
        assert ids(text, pieces, block=512, hold=8) == library.encode(text, add_special_tokens=False).ids


def test_lookahead_is_sufficient(pieces):
    """A token that counts as stable stays, whatever follows: against merging the whole string again."""
    m, rng = pieces.merges, random.Random(3)
    risky = [t for t in range(len(m.length)) if m.look[t] > 40 and m.length[t] > 1]
    spelled = {i: t for t, i in m.vocabulary.items()}
    symbols = {t: [m.vocabulary[c] for c in spelled[t]] for t in risky}
    for _ in range(2000):
        head = [s for t in rng.choices(risky, k=rng.randint(2, 30)) for s in symbols[t]]
        tail = [s for t in rng.choices(risky, k=20) for s in symbols[t]]
        short, whole, at = m.merge(head), m.merge(head + tail), 0
        for a, b in zip(short, whole, strict=False):
            at += m.length[a]
            if at + m.look[a] > len(head):
                break
            assert a == b


def test_both_merging_loops_agree(pieces):
    m, rng = pieces.merges, random.Random(4)
    for _ in range(500):
        symbols = [m.plain[b] for b in "".join(rng.choice("abcdethion") for _ in range(rng.randint(1, 120))).encode()]
        assert m._by_scan(symbols) == m._by_heap(symbols)


def test_decoding_in_blocks(library, pieces):
    spaced, plain = wordbpe.Decoder(pieces.merges), wordbpe.Decoder(pieces.merges, spaced=False)
    for text in ("", "Hello, World! it's", "日本語 😀 <|endoftext|> é"):
        found = library.encode(text, add_special_tokens=False).ids
        for block in (1, 2, 1000):
            assert "".join(spaced.decode(np.array(found, np.uint32), block)) == library.decode(found, skip_special_tokens=False)
    found = np.array(library.encode("Hello, World! 日本語 😀", add_special_tokens=False).ids, np.uint32)
    assert "".join(plain.decode(found, 1)) == "hello , world ! 日本語 😀 "
    cut = [pieces.merges.vocabulary["æĹ"]] if "æĹ" in pieces.merges.vocabulary else [pieces.merges.plain[0xE6]]
    assert "".join(plain.decode(np.array(cut, np.uint32), 1)) == "�"


def test_frames_with_odd_rows(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (None, "Don't stop", "y"), (2, "a" * 200_000, None), (2, "Don't stop", "y"), (2, "Don't stop", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = wordbpe.decode_documents(wordbpe.encode_documents(df, PATH), PATH)
    want = []
    for i, text, _ in rows:
        e = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(e), e, library.decode(e, skip_special_tokens=False)))
    assert sorted(((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert wordbpe.decode_documents(wordbpe.encode_documents(df.where("false"), PATH), PATH).count() == 0


def test_improper_merge_lists_are_refused(tmp_path):
    import json

    whole = json.load(open(PATH, encoding="utf-8"))
    whole["model"]["merges"].reverse()
    (tmp_path / "odd.json").write_text(json.dumps(whole), encoding="utf-8")
    with pytest.raises(ValueError, match="merge"):
        wordbpe.Merges(str(tmp_path / "odd.json"))
