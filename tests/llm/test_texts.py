"""Operators on single texts, against brute force, round trips and planted cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from litspan.llm import bpe, fingerprints, htmltext, langid, licenses, packing, pii, urls

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\n\t", "don't you'll I'VE 'sa 's 't", "ünï çödé 漢字かな 😀 ٣½²", "a" * 5000, " " * 700 + "x", "<|endoftext|> end", "1234567890" * 30, "é" * 2000 + "'ll", "x y\x85z\x1c."]


def frame(spark, texts, extra=True):
    rows = [(i, t, "clash", 0.5, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, score double, block int")
    return df if extra else df.select("doc_id", "text")


def fuzz(n, alphabet="ab'stmdlrvé é12 \n\t\r!?-漢字٣½²    ''SsıLlEe😀", seed=1, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_bpe_equals_the_library(spark):
    texts = ODD + fuzz(3000)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    out = bpe.decode_documents(bpe.encode_documents(frame(spark, texts), MULTI, offsets=True), MULTI)
    for r in out.collect():
        text = texts[r.doc_id] or ""
        want = library.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == text.encode()
        starts = np.frombuffer(r.offsets, "<u4").tolist()
        assert starts == sorted(set(starts)) and (not text or starts[0] == 0)


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k", "byte_bpe_50k"])
def test_every_code_point_as_the_libraries(name):
    """Alone and beside letters, digits, blanks and quotes; in one text for each block of code points."""
    from tokenizers import Tokenizer

    merged = bpe.Merged(bpe.read_ranks(public_tokenizers.path(f"{name}.tiktoken")), "I")
    texts = []
    for k in range(0, 0x110000, 512):
        if not 0xD800 <= k < 0xE000:
            texts.append("".join(f"a{c}1{c} {c}'s  {c}" for c in map(chr, range(k, k + 512))))
    got = [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.encode(texts, merged)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged.ranks, special_tokens={})
    assert got == library.encode_ordinary_batch(texts)
    if name == "byte_bpe_50k":
        assert got == [x.ids for x in Tokenizer.from_file(public_tokenizers.path(f"{name}.json")).encode_batch(texts, add_special_tokens=False)]


def test_cache_forgets_the_older_half():
    merged = bpe.Merged(bpe.read_ranks(MULTI), "I", most=4)
    for piece in ("a", "b", "c", "d", "e"):
        assert merged[piece]
    merged.trim()
    assert list(merged) == ["c", "d", "e"]


def test_own_merges_equal_the_library():
    ranks = bpe.read_ranks(MULTI)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdethion \xc3\xa9") for _ in range(rng.choice([1, 5, 20, 95, 97, 300])))
        assert bpe.merge_piece(piece, ranks) == library._encode_single_piece(piece)


def test_scan_is_associative_over_columns():
    text = " ".join(fuzz(400, seed=5))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    whole = [m.start() for m in __import__("regex").finditer(public_tokenizers.PATTERN, text)]
    assert bpe.piece_starts(points, np.array([0])).tolist() == whole
    assert bpe.piece_starts(np.zeros(0, np.uint32), np.zeros(0, np.intp)).tolist() == []


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + fuzz(200, longest=400) + ["word " * 3000]
    out = packing.pack_documents(frame(spark, texts), PLAIN, block_docs=40).collect()
    pieces: dict[int, list] = {}
    sequences: dict[int, list] = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]]))
        assert np.frombuffer(b"".join(r.ids for r in own), "<u2").tolist() == ids and own[0].doc_tokens == len(ids)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(np.cumsum([0, *[r.length for r in rows[:-1]]]))
        total = sum(r.length for r in rows)
        assert total <= 2048 and total & (total - 1) == 0
    summed = {(r.doc_id, r.start): r.ids_crc32 for r in packing.piece_checksums(packing.pack_documents(frame(spark, texts), PLAIN, block_docs=40)).collect()}
    assert all(summed[r.doc_id, r.start] == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in out)


def slow_pack(lengths, length=2048):
    """Lowest cost that has room, else the roomiest, by lists; costs are n + n * n / 2048 for each piece."""
    pieces, sequences = [], []
    for d, n in enumerate(lengths):
        for k in range(n // length):
            pieces.append((d, k * length, length, len(sequences), 0))
            sequences.append(None)
    left = sum(n % length for n in lengths)
    first, rooms = len(sequences), [length] * (left // length)
    rooms += [1 << b for b in reversed(range(12)) if left % length >> b & 1]
    filled = [[] for _ in rooms]
    for d in sorted(range(len(lengths)), key=lambda d: (-(lengths[d] % length), d)):
        need = lengths[d] % length
        while need:
            room = [r - sum(f) for r, f in zip(rooms, filled, strict=True)]
            cost = [sum(n + n * n / 2048 for n in f) for f in filled]
            able = [s for s in range(len(rooms)) if room[s] >= need]
            s = min(able, key=lambda s: (cost[s], s)) if able else max(range(len(rooms)), key=lambda s: (room[s], -s))
            n = min(need, room[s])
            pieces.append((d, lengths[d] - need, n, first + s, sum(filled[s])))
            filled[s].append(n)
            need -= n
    return pieces


def test_balance_equals_a_slow_version():
    rng = random.Random(9)
    for size in (1, 2, 7, 40):
        for top in (30, 3000, 9000):
            lengths = [rng.randint(1, top) for _ in range(size)] + [500] * 5
            assert packing.pack_lengths(np.array(lengths)) == slow_pack(lengths)


def test_packing_of_hot_ids_in_parts(spark, monkeypatch):
    """Half of all rows have one id, a quarter repeats whole: blocks stay near their mean, and no sequence number is used twice."""
    rows = [(7, f"text {k} of it") for k in range(200)] + [(7, "same")] * 200 + [(k, f"other {k} one") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = packing.pack_documents(df, PLAIN, block_docs=40).collect()
    per_block: dict[int, int] = {}
    for r in out:
        if r.start == 0:
            per_block[r.sequence_id >> 32] = per_block.get(r.sequence_id >> 32, 0) + 1
    assert sum(per_block.values()) == len(rows) and max(per_block.values()) <= 100
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 50 + [4] * 5), pa.array(range(55)), pa.array([2000] * 55), pa.array([b"ab" * 1000] * 55)], names=["block", "id", "n", "ids"])
    monkeypatch.setattr(packing, "MOST_DOCS", 8)
    monkeypatch.setattr(packing, "PART_BYTES", 10_000)
    cut = [(block, t.num_rows) for block, t in packing.parts(iter([batch.slice(0, 7), batch.slice(7)]))]
    assert cut == [(3, 5)] * 10 + [(4, 5)]


def test_packing_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(none, PLAIN).count() == 0
    same = spark.createDataFrame([(1, "a b")] * 5 + [(None, None)], "doc_id long, text string")
    out = packing.pack_documents(same, PLAIN).collect()
    assert sum(r.length for r in out) == 5 * 3 + 1


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = langid.identify(docs).select("doc_id", "lang", "lang_pred", "score", langid.held_out("doc_id").alias("held"))
    rows = out.collect()
    held = [r for r in rows if r.held]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    more = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(10**6, None, "en"), (10**6 + 1, "12 !?", "en"), (None, "the for that", None), (10**6 + 2, "", "fr"), (10**6 + 3, "x" * 10**6, None)], "doc_id long, text string, lang string"))
    found = {r.doc_id: r for r in langid.identify(more.withColumn("score", F.lit("clash"))).collect()}
    assert [found[10**6 + k].lang_pred for k in range(3)] == ["und"] * 3 and found[10**6].score == 0
    assert found[None].lang_pred == "en" and found[10**6 + 3].lang_pred != "und"


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.where("false")).count() == 0
    many = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(many, most_languages=5)


def test_fingerprints(spark):
    texts = [t for t in ODD] + fuzz(120, "abc. \n", 3, 600) + ["A first. A second.\nA third."] * 3
    df = frame(spark, texts)
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(df).collect()}
    order = sorted(range(len(texts)), reverse=True)
    plain = [t or "" for t in texts]
    for k, i in enumerate(order):
        following = plain[order[(k + 1) % len(order)]]
        n = len(plain[i]) // 3
        changed = plain[i][: len(plain[i]) - n] + following[:n]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(plain[i]), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(plain[i]) and r.edited_fingerprint == fingerprints.fingerprint(changed)
        assert (r.near_edited == 1) == (changed == plain[i]) and (r.near_next == 1) == (following == plain[i])
    assert fingerprints.fingerprint_documents(df.where("false")).count() == 0
    alone = fingerprints.fingerprint_documents(df.where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_fingerprints_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a"), (None, "c"), (7, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in fingerprints.fingerprint_documents(df).collect()) == [(0, 1), (5, 1), (5, 1), (5, 1), (7, 0)]


def slow_fingerprint(text):
    """The tree by its description, and the leaves it has."""
    h = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    sections, leaves, body, tops = [[]], [], "", b""
    for paragraph in text.split("\n"):
        sentences = []
        for sentence in paragraph.split(". "):
            runs = [[]]
            for word in sentence.split(" "):
                runs[-1].append(word)
                if zlib.crc32(word.encode()) % 4 == 0:
                    runs.append([])
            sentences.append([h(" ".join(r).encode()) for r in runs if r])
        leaves += [x[:4].hex() for s in sentences for x in s]
        node = h(b".".join(b"".join(s) for s in sentences))
        sections[-1].append((node, "".join(x[:4].hex() for s in sentences for x in s)))
        if node[0] % 8 == 0:
            sections.append([])
    for s in sections:
        tops += h(b"".join(n for n, _ in s))
    body = ";".join(",".join(m for _, m in s) for s in sections)
    return f"{h(tops).hex()};{body}", sorted(leaves)


def slow_likeness(a, b):
    (mark, x), (other, y) = slow_fingerprint(a), slow_fingerprint(b)
    if mark[:32] == other[:32]:
        return 1.0
    rest, shared = list(y), 0
    for leaf in x:
        if leaf in rest:
            rest.remove(leaf)
            shared += 1
    return min(2 * shared / (len(x) + len(y)), 0.999999)


def test_fingerprints_against_a_slow_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    plain = [r.text or "" for r in rows]
    for k, r in enumerate(rows):
        following = plain[(k + 1) % len(plain)]
        changed = fingerprints.edited_text(plain[k], following)
        got = out[r.doc_id]
        assert (got.fingerprint, got.edited_fingerprint) == (slow_fingerprint(plain[k])[0], slow_fingerprint(changed)[0])
        assert got.near_edited == slow_likeness(plain[k], changed) and got.near_next == slow_likeness(plain[k], following)


def test_fingerprints_of_hot_ids(spark):
    """Half of all rows have one id: copies of a text, and different texts."""
    rows = [(7, "the same text")] * 200 + [(7, f"text {k} of it") for k in range(200)] + [(k, f"other {k} one") for k in range(100, 300)] + [(None, f"none {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(6)
    dealt = fingerprints.with_successor(df, buckets=64)
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) <= len(rows) + 64 * 6
    out = fingerprints.fingerprint_documents(df).collect()
    assert len(out) == len(rows) and sum(r.near_next == 1 for r in out) == 199
    order = sorted(set(rows), key=lambda r: -(r[0] if r[0] is not None else -1))
    want = {r.doc_id: r for r in out if r.doc_id in range(101, 300)}
    for (i, t), (_, following) in zip(order, order[1:], strict=False):
        if i is not None and 100 < i:
            assert want[i].near_next == slow_likeness(t, following)
    with pytest.raises(TypeError):
        fingerprints.fingerprint_documents(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_edits_are_located():
    lines = [f"line {i} of the text. It goes on." for i in range(60)]
    other = list(lines)
    other[17] = "changed. It goes on."
    del other[40]
    a, b = fingerprints.fingerprint("\n".join(lines)), fingerprints.fingerprint("\n".join(other))
    assert fingerprints.differing_paragraphs(a, b) == ([17, 40], [17])
    assert fingerprints.differing_paragraphs(a, a) == ([], [])


def test_near_copies_across_lengths_share_leaves():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    for sentence in (5, 12, 40):
        text = " ".join(rng.choice(words) + "." * (k % sentence == sentence - 1) for k in range(200))
        for n in (235, 245, 255, 270):
            before, after = text[:n], text[:n] + " and five words more here"
            assert fingerprints.likeness(fingerprints.fingerprint(before), fingerprints.fingerprint(after)) >= 0.7, (sentence, n)


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    for t in fuzz(20_000, "a@.1 -+()b0é9\n", 2, 40) + ["4111 1111 1111 1111 and 1.2.3.4.5", "a@b.c@d.e", "9" * 50_000, "a" * 50_000 + "@", "." * 3000 + "@x.y"]:
        assert pii.base_spans(t) == brute_spans(t)


def card(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def test_bootstrapping_finds_unseen_identifiers(spark):
    rng = random.Random(5)
    rows = [(i, f"card number: {card(rng)} filler end {i}") for i in range(12)]
    rows += [(50, "card number: 12345678 filler end"), (51, "version 20240101 of it"), (52, None), (53, "")]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.stop) for s in out[50].more] == [("id", 13, 21)]
    assert not out[51].more and not out[51].base and not out[52].base and out[0].base[0].kind == "card"
    clash = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], "doc_id long, text string, n_chars long, base string, mark int, Spans int, n int")
    clean = pii.redact(clash).collect()
    told = {r.doc_id: r for r in clean}
    assert told[50].text == "card number: [ID] filler end" and told[50].n_chars == len(told[50].text) and told[51].text == rows[13][1] and told[52].text is None
    assert (told[50].base, told[50].mark, told[50].Spans, told[50].n) == ("x", 2, 3, 4)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted(rng):
    """Texts with seeds and with unseen kinds (the spans of the latter), and with numbers that are nobody's."""
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    words = "stone river light window garden paper winter table under morning quiet forest glass north".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    iban = lambda: f"DE{pick('0123456789', 20)}"
    made = {
        "seed mail": lambda: ("please write to", f"{pick('abcdef', 6)}@{pick('xyz', 5)}.org", "for an answer", False),
        "seed card": lambda: ("charged to account", card(rng), "on file", False),
        "token": lambda: (f"{rng.choice(['token', 'api_token', 'accessToken', 'secret'])} {rng.choice(['= ', '=', ': '])}{chr(34)}", pick("0123456789abcdef", 32), f"{chr(34)} {rng.choice(words)}", True),
        "iban": lambda: ("charged to account", iban(), "on file", True),
        "iban elsewhere": lambda: ("the customer's IBAN", iban(), "was closed", True),
        "record": lambda: ("patient record MRN", pick("0123456789", 9), "admitted on", True),
        "date": lambda: ("published on", f"{rng.randint(1900, 2020)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", rng.choice(words), False),
        "part": lambda: (rng.choice(words), f"PN-{pick('0123456789', 6)}", rng.choice(words), False),
    }
    known = [iban() for _ in range(8)]
    mrns = [pick("0123456789", 9) for _ in range(8)]
    rows, want, kinds = [], {}, []
    for i in range(400):
        kind = rng.choice(list(made))
        left, body, right, sought = made[kind]()
        if kind.startswith("iban") and rng.random() < 0.5:
            body = rng.choice(known)  # the same account in both contexts
        if kind == "record" and rng.random() < 0.4:
            body, left, right = rng.choice(mrns), *rng.choice([("patient record MRN", "admitted on"), ("charged to account", "on file")])
        head = f"{prose(rng.randint(2, 9))} {left}{'' if left[-1] in '= :' + chr(34) else ' '}"
        rows.append((i, f"{head}{body}{'' if right[0] == chr(34) else ' '}{right} {prose(5)}."))
        kinds.append(kind)
        if sought:
            want[i] = (len(head), len(head) + len(body))
    return rows, want, kinds


def slow_discovery(rows):
    """The graph by dictionaries; scores by rounds until nothing changes."""
    found = {i: pii.contexts(t, pii.base_spans(t)) for i, t in rows}
    edges = {(p, x) for places in found.values() for x, around, *_ in places for p in around}
    seeds = {(x, kind) for places in found.values() for x, _, kind, *_ in places if kind}
    of = {}
    for p, x in edges:
        of.setdefault(p, set()).add(x)
    sure = dict.fromkeys(seeds, 1.0)
    based = {x for x, kind in seeds if kind != "secret"}
    for _ in range(30):
        new = dict.fromkeys(seeds, 1.0)
        for p, xs in of.items():
            for kind in {k for _, k in sure}:
                held = [sure[x, kind] for x in xs if (x, kind) in sure]
                if sum(v >= 0.6 for v in held) >= 3:
                    for x in xs - based:
                        new[x, kind] = max(new.get((x, kind), 0), sum(held) / len(xs))
        grown = sum(new.values()) - sum(sure.values())
        sure = new
        if grown <= 0.1 * len(set(new) - {s for s in seeds if s[0] in based}) / 1000:
            break
    likely = {x for (x, _), v in sure.items() if v >= 0.6} - based
    return {(i, a, b) for i, places in found.items() for x, _, kind, a, b in places if x in likely and kind in (None, "secret")}


def test_unseen_kinds_against_a_slow_graph(spark, monkeypatch):
    rows, want, kinds = planted(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, s.start, s.stop) for r in pii.find(df).collect() for s in r.more}
    assert got == slow_discovery(rows)
    sought = {(i, *span) for i, span in want.items()}
    assert len(got & sought) >= 0.9 * len(sought) and len(got & sought) >= 0.9 * len(got)
    for kind in ("token", "iban", "iban elsewhere", "record"):
        own = {x for x in sought if kinds[x[0]] == kind}
        assert len(own & got) >= 0.9 * len(own), kind
    from litspan.llm import common

    monkeypatch.setattr(common, "HOTTEST", 8)
    assert {(r.doc_id, s.start, s.stop) for r in pii.find(df).collect() for s in r.more} == got


def test_candidates_beside_base_spans():
    t = "mail=a@b.org;id=AB123456, key: \"DE89 3704 0044 0532 0130 00\" x12345678y@z 10.0.0.1/abc12345d."
    spans = sorted((a, b) for _, a, b in pii.base_spans(t))
    assert [t[a:b] for a, b in pii.candidates(t, spans)] == ["AB123456", "DE89 3704 0044 0532 0130 00", "x12345678y@z", "abc12345d"]


def test_rows_of_one_id(spark):
    rows = [(1, 'token = "ab12cd34ef56"')] * 3 + [(1, "nothing here"), (None, 'secret="ff00ff00ff00"'), (None, None)]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.more)) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (1, 1)]
    told = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text or "" for r in told) == ["", "nothing here", 'secret="[SECRET]"'] + ['token = "[SECRET]"'] * 3


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    starts = {p: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for p in licenses.BASE}
    every = [i for x in starts.values() for i in x]
    return len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted({licenses.BASE[p] for p, x in starts.items() if x}))


def test_licenses(spark):
    texts = ODD + ["CC-BY CC BY ccby xcc by", "All rights reserved. ALL RIGHTS\nreserved", "Released under the MIT License.", "cc by " * 3000, "x " * 20 + licenses.TEMPLATES["bsd"] + " y", "This work is licensed, under the GNU General Public License, version 3!"]
    texts += [" ".join(random.Random(i).choice(["cc", "by", "all", "rights", "reserved", "general", "public", "license", "é"]) for _ in range(40)) for i in range(60)]
    out = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    by = {texts[i]: r for i, r in out.items() if texts[i]}
    assert by["Released under the MIT License."].labels == "mit" and "bsd" in by[texts[len(ODD) + 4]].labels and by[texts[len(ODD) + 5]].labels == "gpl,gpl-3"
    assert licenses.scan(frame(spark, texts).where("false")).count() == 0
    twice = licenses.scan(frame(spark, ["Released under the MIT License."]).union(frame(spark, ["Released under the MIT License."]))).collect()
    assert [r.labels for r in twice] == ["mit", "mit"] and twice[0].score == 1


def test_licenses_with_inserted_words(spark):
    told = {
        "This work is licensed under the terms of the GNU General Public License version 3": "gpl,gpl-3",
        "Released under the terms of the MIT license": "mit",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License": "gpl,gpl-2",
        "GNU General Public License version 3 and under the work is licensed this": "gpl",  # not in order
    }
    bsd, gpl = licenses.words_of(licenses.TEMPLATES["bsd"]), licenses.words_of(licenses.TEMPLATES["gpl-3"])
    for n in range(3, 7):
        told[" ".join(bsd[:9] + ["x"] * n + bsd[9:])] = "bsd"
        told[" ".join(gpl[:5] + ["x"] * n + gpl[5:])] = "gpl,gpl-3"
    told["general public license " * 50 + " ".join(gpl) + " general public license" * 50] = "gpl,gpl-3"
    out = {r.doc_id: r.labels for r in licenses.scan(frame(spark, list(told))).collect()}
    assert [out[i] for i in range(len(told))] == list(told.values())
    plain = {r.label: (r.first_word, r.n_words) for r in licenses.spans(frame(spark, [" ".join(["x"] * 5 + gpl[:5] + ["x"] * 6 + gpl[5:])]), templates=licenses.TEMPLATES).collect()}
    assert plain["gpl-3"] == (5, len(gpl) + 6)


def test_whole_license_texts(spark):
    """Whole texts, with words changed, missing and inserted, and a text that only shares their hashes' words out of order."""
    from litspan.llm.license_texts import WHOLE

    rng = random.Random(4)
    rows, want = [], []
    for key, text in WHOLE.items():
        words = text.split()
        for edits in (0, 4, 10):
            edited = list(words)
            for _ in range(edits if len(words) > 90 else edits // 4):
                k = rng.randrange(len(edited))
                edited[k : k + rng.randint(0, 1)] = rng.choice([["inserted", "words"], ["changed"], []])
            rows.append("Copyright 1999 somebody. " + " ".join(edited) + " And more.")
            want.append(key.split("/")[0])
    rows.append(" ".join(rng.sample(WHOLE["mit/whole"].split(), 150)))
    out = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    for i, label in enumerate(want):
        assert label in out[i].labels.split(","), (i, label, out[i].labels)
    assert out[len(want)].labels == ""
    found = {r.label: (r.first_word, r.n_words, r.cover) for r in licenses.spans(frame(spark, [rows[0]]), templates={"mit": WHOLE["mit/whole"]}).collect()}
    assert found == {"mit": (3, len(licenses.words_of(WHOLE["mit/whole"])), 1.0)}


def slow_spans(words, template):
    """Chains of votes, place by place: the best cover of all first votes, with its span."""
    size, drift = len(template) - 2, licenses.drift_of(template)
    votes = sorted((p, q) for p in range(len(words) - 2) for q in range(size) if words[p : p + 3] == template[q : q + 3])
    best = (0, 0, 0)
    for p0, q0 in votes:
        ends = {(p0, q0): 1}
        for p, q in votes:
            if p > p0 and q > q0 and p - p0 <= drift + q - q0:
                ends[p, q] = max([n for (a, b), n in ends.items() if a < p and b < q], default=-1) + 1
        n = max(ends.values())
        best = max(best, (n, -p0, -min(p for (p, _), m in ends.items() if m == n)))
    return best[0] / size, -best[1], -best[2] - -best[1] + 3


def test_license_chains_against_a_slow_version(spark):
    rng = random.Random(6)
    template = licenses.words_of(licenses.VARIANTS["gpl-3/free"])
    rows = []
    for _ in range(60):
        words = list(template)
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 2)] = rng.choice([["the"], ["free", "software"], ["x"] * rng.randint(1, 6), []])
        rows.append(["y"] * rng.randint(0, 4) + words)
    found = {}
    for r in licenses.spans(frame(spark, [" ".join(w) for w in rows]), templates={"t": " ".join(template)}).collect():
        found[r.doc_id] = max(found.get(r.doc_id, (0,)), (r.cover, -r.first_word, -r.n_words))
    for i, words in enumerate(rows):
        cover, first, n = slow_spans(words, template)
        if cover >= licenses.COVER:
            assert found[i][0] == pytest.approx(cover) and (-found[i][1], -found[i][2]) == (first, n)
        else:
            assert i not in found


def test_licenses_of_rows_with_one_id(spark):
    rows = [(1, "Released under the MIT license"), (1, "nothing"), (None, "All rights reserved"), (None, None)]
    out = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in out) == [(0, ""), (0, "reserved"), (1, ""), (1, "mit")]


def test_gram_hashes_equal_the_engines(spark):
    words = [["licensed", "under", "the"], ["é", "漢字", "x" * 50], ["a", "b", "c"]]
    got = spark.createDataFrame([(w,) for w in words], "w array<string>").selectExpr("xxhash64(w[0], w[1], w[2]) AS h").collect()
    assert [r.h for r in got] == [licenses.gram_hash(w) for w in words]


def test_licenses_side_by_side(spark):
    told = {
        "Released under the MIT License, or licensed under the Apache License Version 2": "apache-2.0,mit",
        "Licensed under the Apache License, Version 2.0. This work is licensed under the GNU General Public License version 3": "apache-2.0,gpl,gpl-3",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "Creative Commons Attribution 4.0 International License": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa",
        "This work is licensed under a Creative Commons Attribution-Share Alike 4.0 International License": "cc-by-sa",
        "Creative Commons Attribution-NoDerivatives 4.0 International License": "cc-by-nd",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc-sa",
    }
    out = {r.doc_id: r.labels for r in licenses.scan(frame(spark, list(told))).collect()}
    assert [out[i] for i in range(len(told))] == list(told.values())


PAGE = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="layout"><aside>Side</aside><article><h1>The  Title</h1><p>First &amp; <b>bold<br>text is long enough to be taken as content by its ratio.<p>Short.</p>
<div class="ad">Buy</div><form><input>Subscribe</form><p>Last&nbsp;one, which goes on for some length as well, so that it counts.</article><section id="comments"><p>A reader says a lot of things that are as long as the text.</p></section></div><footer>&copy; us"""
WANT = "The Title\nFirst & bold text is long enough to be taken as content by its ratio.\nShort.\nLast one, which goes on for some length as well, so that it counts."


def test_main_text(spark):
    pages = {1: (PAGE, WANT), 2: (PAGE.replace("article", "div"), WANT), 3: (None, ""), 4: ("", ""), 5: ("<nav>only</nav>", ""), 6: ("plain words", "plain words"), 7: ("<p>a<p>b", "a\nb"), 8: ("<div>" * 20_000 + "deep" + "</div>" * 9, "deep"), 9: ("<p>cut <b", "cut"), 10: ("<div class='content no-sidebar'><p>kept</p><p class=share-bar>gone</p></div>", "kept")}
    df = spark.createDataFrame([(i, h, "clash") for i, (h, _) in pages.items()], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract(df).collect()}
    assert {i: got[i] for i in pages if i != 9} == {i: w for i, (_, w) in pages.items() if i != 9} and got[9].startswith("cut")
    assert htmltext.extract(df.where("false")).count() == 0


class Element:
    def __init__(self, tag, marks, around):
        self.tag, self.around, self.parts = tag, around, []
        words = {w for m in marks for w in re.split(r"[\s_-]", re.sub(r"\b(?:no|has|with|without)[-_][\w-]+", " ", m.lower()))}
        known = set("ad ads advert adverts banner comments sidebar search share notice cookie footer header nav menu promo related social".split()) & words
        self.doubt = 9 if tag in ("nav", "footer", "button", "label") else 0.9 if "comments" in known else 0.5 if known or tag in ("aside", "form", "header", "fieldset", "dialog") else 0

    def up(self):
        return [self, *(self.around.up() if self.around else [])]


def slow_main_text(html, reverse=False):
    """The method again, on well-formed pages: a tree of elements, every sum made anew from the lines."""
    from html.parser import HTMLParser

    root = Element("html", [], None)
    lines, state = [[[], 0]], {"at": root, "silent": 0}

    class Tree(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag in htmltext.BLOCKS:
                lines.append([[], 0])
            lines[-1][1] += 1
            if tag in htmltext.EMPTY:
                return
            if tag in htmltext.SILENT:
                state["silent"] += 1
            state["at"] = Element(tag, [v for k, v in attrs if k in ("class", "id", "role")], state["at"])

        def handle_endtag(self, tag):
            if tag in htmltext.BLOCKS:
                lines.append([[], 0])
            lines[-1][1] += 1
            if tag in htmltext.SILENT:
                state["silent"] -= 1
            while tag in [e.tag for e in state["at"].up()]:
                out = state["at"].tag
                state["at"] = state["at"].around
                if out == tag:
                    break

        def handle_data(self, data):
            if not state["silent"]:
                lines[-1][0].append((state["at"], data))

    parser = Tree()
    parser.feed(html)
    parser.close()
    # tags between blocks count for the next line with text, as its own
    kept, tags = [], 0
    for parts, n in lines:
        tags += n
        if "".join(t for _, t in parts).strip():
            kept.append((parts, n))
    span = lambda t: len(" ".join(t.split()))
    ratio = [sum(span(t) for _, t in parts) / max(1, n) for parts, n in kept]
    weights = {d: np.exp(-d * d / 2) for d in range(-3, 4)}
    smoothed = []
    for k in range(len(ratio)):
        near = [(weights[d], ratio[k + d]) for d in weights if 0 <= k + d < len(ratio)]
        smoothed.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smoothed) / len(smoothed)
    bar = min(mean / 2, mean - 0.5 * (sum((r - mean) ** 2 for r in smoothed) / len(smoothed)) ** 0.5)
    content = [(r >= bar) != reverse for r in smoothed]
    atoms = [(k, e, t) for k, (parts, _) in enumerate(kept) for e, t in parts]
    every = {id(e): e for _, e, _ in atoms for e in e.up()}.values()
    size = lambda e, some: sum(span(t) for _, x, t in some if e in x.up())
    good = [a for a in atoms if content[a[0]]]
    furniture = {e for e in every if e.doubt and size(e, good) <= e.doubt * size(root, good)}
    if all(furniture & set(e.up()) for _, e, _ in good):
        furniture = {e for e in every if e.doubt == 9}
    atoms = [a for a in atoms if not furniture & set(a[1].up())]
    good = [a for a in atoms if content[a[0]]]
    agrees = {e: 2 * size(e, good) / max(1, size(e, atoms) + size(root, good)) for e in every if e.tag not in htmltext.PARTS}
    best = max(agrees.values())
    if not good:
        return ""
    if best < 0.5:
        chosen = good
    else:
        core = max((e for e in agrees if agrees[e] == best), key=lambda e: len(e.up()))
        wide = [e for e in core.up() if agrees.get(e, 0) >= 0.95 * best][-1]
        chosen = [a for a in atoms if wide in a[1].up() or content[a[0]]]
    return "\n".join(t for k in range(len(kept)) if (t := " ".join("".join(t for i, _, t in chosen if i == k).split())))


def variants(html):
    """The page as it is, without an article element, and wrapped in elements with the names of furniture."""
    plain = html.replace("<article>", "<div>").replace("</article>", "</div>")
    wrap = lambda a, b: plain.replace("<body>", f"<body>{a}").replace("</body>", f"{b}</body>")
    return [html, plain, wrap("<form action='/x'>", "</form>"), wrap("<div id='search-page'>", "</div>"), wrap("<div class='with-sidebar sidebar'>", "</div>")]


def test_main_text_against_a_slow_version(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r.html]
    assert all("<article>" in p and "<body>" in p for p in pages)
    for page in pages:
        texts = {htmltext.main_text(v) for v in variants(page)}
        assert texts == {slow_main_text(page)}
        article = re.search("(?s)<article>(.*)</article>", page)[1]
        blocks = [" ".join(re.sub("<[^>]*>", "", b).split()) for b in re.split(r"</?(?:h1|p|li|ul)\b[^>]*>", article.replace("<br>", "\n"))]
        import html

        assert texts == {"\n".join(html.unescape(b) for b in blocks if b)}


def test_ratios_decide_the_main_text(spark, sf_dir, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect() if r.html]
    straight = [htmltext.main_text(p) for p in pages]
    right = htmltext.content_lines
    monkeypatch.setattr(htmltext, "content_lines", lambda sizes, tags: [not x for x in right(sizes, tags)])
    turned = [htmltext.main_text(p) for p in pages]
    assert turned == [slow_main_text(p, reverse=True) for p in pages]
    assert sum(a != b for a, b in zip(straight, turned, strict=True)) > 0.9 * len(pages)


def test_names_of_furniture_and_comments():
    say, reply = "<p>" + "An article of some length. " * 20 + "</p>", "<p>" + "A reader answers at length. " * 20 + "</p>"
    text, answer = ("An article of some length. " * 20).strip(), ("A reader answers at length. " * 20).strip()
    assert htmltext.main_text(f"<body><div class=post>{say}</div><div id=comments>{reply * 3}</div></body>") == text
    assert htmltext.main_text(f"<body><div id=comments>{reply * 3}</div></body>") == "\n".join([answer] * 3)
    assert htmltext.main_text(f"<body>{say}<p>Last. <span class='share'>Share this</span> Really.</p></body>") == f"{text}\nLast. Really."
    assert htmltext.main_text(f"<body><nav>{reply}</nav><footer>{reply}</footer></body>") == ""
    assert htmltext.main_text(f"<body><aside><p>Beside.</p></aside><form>{say}<label>Mail</label><button>Send</button></form></body>") == text
    assert htmltext.main_text(f"<body>{say}<div class='sidebar'>{reply}</div><div>{'<p>x</p>' * 3}</div>{say}</body>") == f"{text}\nx\nx\nx\n{text}"


def test_main_text_beside_a_dominant_block():
    long, menu = "word and more " * 400, "<a href=/1>Home</a> <a href=/2>News</a> <a href=/3>About</a>"
    say = " ".join(long.split())
    assert htmltext.main_text(f"<body><h1>Title</h1><p>{long}</p><p>{'closing words ' * 6}</p></body>") == f"Title\n{say}\n{' '.join(['closing words'] * 6)}"
    parts = "".join(f"<section><h2>Part {k}</h2><p>A short part.</p></section>" for k in range(5))
    text = "\n".join(f"Part {k}\nA short part." for k in range(5))
    assert htmltext.main_text(f"<body><div>{menu}</div><div><section><p>{long}</p></section>{parts}</div></body>") == f"{say}\n{text}"
    assert htmltext.main_text(f"<div>{menu}</div><div><p>{long}</p><ul><li><a href=/4>A</a><li><a href=/5>B</a><li><a href=/6>C</a></ul></div>") == f"{say}\nA\nB\nC"
    assert htmltext.main_text(f"<body><ul><li>{menu.replace(' <', '<li><')}</ul><div>By <a href=/x>One</a></div><p>{long}</p></body>") == f"By One\n{say}"


def test_url_verdicts(spark):
    link = "<link rel='canonical' href='{}'>"
    pages = [
        (1, "https://a.com/x", link.format("https://b.com/de/1")), (2, "http://c.com/q#f", '<meta http-equiv="Refresh" content="0; URL=//a.com/x">'), (3, "HTTPS://M.Example.ORG/en/12?x", None),
        (4, None, None), (5, "no scheme", link.format("https://b.com/de/1")), (6, "https://org", None), (7, "https://z.net/a", link.format("https://y.org/k")), (8, "https://z.net/b", link.format("/a")),
        (9, "https://z.net/c", link.format("https://z.net/b")), (10, "https://w.net/c", link.format("https://w.com/de/")), (11, "https://w.net/c", None),
    ]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, decision string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert out == {
        1: ("a.com", "/x", None, "block"), 2: ("c.com", "/q", None, "block"), 3: ("m.example.org", "/en/12", "example.org/en/1", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"),
        6: ("org", "", None, "allow"), 7: ("z.net", "/a", None, "allow"), 8: ("z.net", "/b", None, "allow"), 9: ("z.net", "/c", None, "allow"), 10: ("w.net", "/c", None, "block"), 11: ("w.net", "/c", None, "block"),
    }
    assert urls.judge(df.where("false")).count() == 0


def test_links_in_markup(spark):
    """Comments, words of rel in any order, character references, attributes like others, and paths that are empty."""
    pages = [
        ("http://a.net/1", "<!-- <link rel=canonical href=/no> --><LINK href='/x?a=1&amp;b=2&#38;c&#x3d;3' data-rel=canonical REL='shortlink canonical'>"),
        ("http://a.net/2", "<link rel='noncanonical' href='/no'><link rel='canonical-ish' href=/no><link data-href='/no' rel=canonical href=&#47;y>"),
        ("http://a.net/3", "<meta content='5; url=/z&quot;' http-equiv=\"refresh\"><!-- <meta http-equiv=refresh content='0;url=/no'> -->"), ("http://a.net/4", None), (None, "<link rel=canonical href=/no>"),
    ]
    df = spark.createDataFrame(pages, "url string, html string")
    assert sorted((r.a[-1], r.b[12:]) for r in urls.links(df).collect()) == [("1", "/x?a=1&b=2&c=3"), ("2", "/y"), ("3", '/z"')]
    two = [("http://b.net", "<link rel=canonical href='http://c.com/de/'>"), ("http://b.net/", None), ("http://b.net/#x", None), ("http://b.net/?q", None)]
    assert [r.verdict for r in urls.judge(spark.createDataFrame(two, "url string, html string")).orderBy("url").collect()] == ["block", "block", "block", "allow"]


def test_a_table_of_rules_against_brute_force(spark, monkeypatch):
    from litspan.llm import common

    rng = random.Random(3)
    hosts = [".".join(rng.choice(["a", "b", "c", "shop", "news"]) for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".org", ".net", ""]) for _ in range(300)]
    path = lambda: "".join(rng.choice(["/a", "/b", "/1", "/12", "x", ""]) for _ in range(rng.randint(0, 4)))
    rules = list({(f"{rng.choice(hosts).split('.', rng.randint(0, 1))[-1]}/{path().lstrip('/')}", rng.choice(["allow", "block"])) for _ in range(1500)})
    rules = [(r, v) for r, v in dict(rules).items()]
    pages = [(k, f"http://{rng.choice(hosts)}{p if (p := path()).startswith('/') or not p else '/' + p}{rng.choice(['', '?q=1', '#f'])}", None) for k in range(3000)] + [(9000 + k, "http://hot.com/a", None) for k in range(3000)] + [(1, None, None)]
    rules += [("hot.com/", "block"), ("no-slash", "block")]
    df = spark.createDataFrame([(*p, "clash", 1, 2) for p in pages], "page_id long, url string, html string, own string, at int, N int")
    monkeypatch.setattr(common, "HOTTEST", 16)
    out = urls.judge(df, rules=spark.createDataFrame(rules, "rule string, verdict string")).collect()
    assert len(out) == len(pages) and all((r.own, r.at, r.N) == ("clash", 1, 2) for r in out)
    for r in out:
        fits = [(len(x), x, v) for x, v in rules if "/" in x and (r.host == x.split("/")[0] or r.host.endswith("." + x.split("/")[0])) and r.path.startswith(x[x.index("/") :])]
        want = max(fits, default=(0, None, "allow"))
        assert (r.rule, r.verdict) == want[1:], r


def test_relative_and_repeated_links(spark):
    from urllib.parse import urljoin

    base = "https://Z.net/a/b/page?q=1#f"
    targets = "en/index.html ../a ../../../x ?id=3 ./ . .. ../ /r/./s/../t /p?u=http://o.com/ //h.org/x https://k.org/y x#g ./../c/.d g?y/../z ;x".split()
    link, turn = "<link rel='canonical' href='{}'>", '<meta http-equiv="Refresh" content="0; URL={}">'
    pages = [(base, link.format(t)) for t in targets] + [("https://z.net", link.format("v"))]
    df = spark.createDataFrame(pages, "url string, html string")
    assert sorted(r.b for r in urls.links(df).collect()) == sorted([*(urljoin(base, t) for t in targets), "https://z.net/v"])
    many = [
        ("https://w.net/1", "".join(f.format(t) for f in (link, turn) for t in ("x", "../y"))), ("https://w.net/2", "<base href='/d/e/'>" + link.format("x")),
        ("https://w.net/3", link.format("mailto:a") + link.format("https://b.com/de/1")), ("https://w.net/4/5", turn.format("../3")), ("https://w.net/6?id=1", link.format("?id=3")), ("https://w.net/6?id=3", link.format("3")),
    ]
    df = spark.createDataFrame(many, "url string, html string")
    edges = sorted((r.a[-1], r.b) for r in urls.links(df.where("url < 'https://w.net/3'")).collect())
    assert edges == [("1", "https://w.net/x"), ("1", "https://w.net/x"), ("1", "https://w.net/y"), ("1", "https://w.net/y"), ("2", "https://w.net/d/e/x")]
    assert [r.verdict for r in urls.judge(df).orderBy("url").collect()] == ["allow", "allow", "block", "block", "block", "block"]
