"""Texts on which an operator once took square time or ended its phrases early."""

import random
import re
import time

import numpy as np
import pytest

from concordat.llm import langid, private


def phrases_by_force(parser, lang, text):
    """The greedy parse, one symbol at a time, from the learned text alone."""
    learned = "".join(map(chr, parser.symbol[langid.code_points(langid.dealt(LEARNED[lang]))].tolist()))
    symbols = "".join(map(chr, parser.symbol[langid.code_points(text)].tolist()))
    n, phrase = int(bool(text)), ""
    for c in symbols:
        if phrase + c in learned:
            phrase += c
        else:
            n, phrase = n + 1, c if c in learned else ""
    return n


LEARNED = {"x": ["the quick brown fox jumps over the lazy dog " * 3, "aaaaab"], "y": ["der schnelle braune fuchs springt " * 4 + "zzzz"]}


def test_phrases_go_over_stretches():
    parser = langid.Parser(LEARNED)
    rng = random.Random(4)
    words = "the brown dog jumps over quick fox der braune fuchs zz aaa 語 9".split()
    texts = [" ".join(rng.choices(words, k=1_100)), "a" * 5_000, "ab" * 2_600, "z" * 1_025, "", "q", "the fox " * 128, "語" * 2_100, " ".join(rng.choices(words, k=900))]
    assert max(map(len, texts)) >= 5_000
    codes = langid.code_points("".join(texts))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = parser.phrases(codes, offsets)
    assert got.tolist() == [[phrases_by_force(parser, lang, t) for lang in parser.langs] for t in texts]


def test_every_chosen_text_is_learned_from():
    assert langid.dealt(["aaaa", "bb", "cccccccc"], 16) == "aaaa bb ccccccc"
    assert langid.dealt(["a" * 100, "b" * 100, "c" * 100], 33) == " ".join([x * 10 for x in "abc"])
    assert langid.dealt([], 5) == langid.dealt([""], 5) == ""
    many = [chr(97 + k % 26) * 4_000 for k in range(200)]
    assert langid.CHARS - 200 < len(langid.dealt(many)) <= langid.CHARS and set(langid.dealt(many)) >= set("abcdefghijklmnopqrstuvwxyz")


def test_addresses_and_secrets_as_their_patterns_say():
    ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
    value = re.compile(r"[\x20\t]{0,4}[\"']?((?=[^\s\"'<>,;0-9]*[0-9])(?=[^\s\"'<>,;A-Za-z]*[A-Za-z])[^\s\"'<>,;]{8,})")
    rng = random.Random(6)
    for _ in range(4_000):
        text = "".join(rng.choices(["1", "2", "55", "300", ".", ".", " ", "a"], k=rng.randint(0, 30)))
        want = [m.span() for m in ip.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
        assert list(private.addresses(text)) == want
        text = "".join(rng.choices(["token", "=", ":", "a", "7", " ", "'", '"', "abcdefgh", "12345678", "pwd", ";", "secret = ", "  "], k=rng.randint(0, 20)))
        want, free = [], 0
        for m in re.finditer("[:=]", text):
            if m.start() >= free and private._NAME.search(text, max(free, m.start() - private._NAMED), m.start()) and (v := value.match(text, m.end())):
                free = v.end(1)
                want.append((*v.span(1), private.SECRET))
        assert private.secrets(text) == want


@pytest.mark.parametrize("unit", ["1", "token=", "1.", "+1", "@", "1 ", "+1((", "a5@example.org ", "pwd:x"])
def test_a_megabyte_in_seconds(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.time()
    private.protected(text)
    assert time.time() - began < 10
