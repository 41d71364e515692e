import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.binary(max_size=40).map(lambda b: b.replace(b"\0", b" "))), max_size=5))
def test_words_of_texts(texts):
    w = text.hash_words(texts)
    want = [(i, x) for i, t in enumerate(texts) for x in (t or b"").split()]
    assert [w.raw[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == [x for _, x in want]
    assert w.doc.tolist() == [i for i, _ in want]
    assert w.bounds.tolist() == np.cumsum([0, *(len((t or b"").split()) for t in texts)]).tolist()
    by = {}
    assert all(by.setdefault(x, h) == h for (_, x), h in zip(want, w.hashes.tolist(), strict=True)) and len(set(by.values())) == len(by)


def test_blocks_give_the_same_hashes(monkeypatch):
    words = [b"w%d" % i for i in range(500)] + [b"long" * 100]
    whole = text.hash_words([b" ".join(words)]).hashes
    monkeypatch.setattr(text, "_BLOCK", 64)
    monkeypatch.setattr(text, "_POWERS", {})
    assert text.hash_words([b" ".join(words)]).hashes.tolist() == whole.tolist()
    assert len(set(whole.tolist())) == len(words)


def test_order_of_bytes_and_words_counts():
    h = text.hash_words([b"ab ba aab aba a aa"]).hashes
    assert len(set(h.tolist())) == 6
    assert len(set(text.grams(np.concatenate([h, h[::-1]]), 4).tolist())) == 9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 14))
def test_grams(words, k):
    got = text.grams(np.array(words, np.uint64), k)
    gold = int(text._GOLD)
    want = [sum(words[i + j] * pow(gold, k - 1 - j, 2**64) for j in range(k)) % 2**64 for i in range(len(words) - k + 1)]
    assert got.tolist() == (text.mix(np.array(want, np.uint64)).tolist() if want else [])


def test_latin_pattern():
    p = text.latin_pattern(r"'s| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    assert p.findall("Ab's é1²  \n!x") == ["Ab", "'s", " é", "  ", "\n", "!", "x"] or "".join(p.findall("Ab's é  \n!x")) == "Ab's é  \n!x"


def test_known_lists_are_made_once():
    calls = []

    def ask(known, strings):
        joined = "".join(strings)
        lengths = np.array([len(x) for x in strings], np.int64)
        ends = np.cumsum(lengths)
        keys, checks = text.hash_codes(np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends - lengths, ends)

        def make(places):
            calls.append([strings[i] for i in places])
            return np.array([len(strings[i]) for i in places], np.int32), np.ones(len(places), np.int64)

        return known.lists.gather(known.numbers(keys, checks, make))[0].tolist()

    known = text.Known(np.int32, 4)
    assert ask(known, ["bb", "a", "bb", "日本語\U0001f600"]) == [2, 1, 2, 4] and len(calls[0]) == 3
    assert ask(known, ["a", "ccc"]) == [1, 3] and calls[1] == ["ccc"]
    assert ask(known, ["eeeee", "bb"]) == [5, 2] and calls[2] == ["eeeee"]
    assert ask(known, ["bb"]) == [2] and calls[3] == ["bb"]  # more than four had been kept


def test_hashes_tell_strings_apart():
    rng = np.random.default_rng(2)
    strings = list({"".join(chr(c) for c in rng.choice([97, 98, 233, 8212, 128512], n)) for n in range(1, 8) for _ in range(400)})
    lengths = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(lengths)
    for hashes in text.hash_codes(np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32), ends - lengths, ends):
        assert len(set(hashes.tolist())) == len(strings)
