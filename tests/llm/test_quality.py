from __future__ import annotations

import random
import re
from collections import Counter

from speclake.llm import quality



def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    places = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(places),
    )


def test_base_counts_equal_brute_force(documents):
    rng = random.Random(1)
    texts = [None, "", " \n\x0b ", "a", "a a a a", "a b c a b c", "#x|<>\n#x|<>\n\n", "é ü *"]
    texts += [
        "".join(rng.choice(["a", "b", " ", "\n", "#", "é", "\t", "x y"]) for _ in range(rng.randint(0, 90)))
        for _ in range(150)
    ]
    texts.append("word " * 30_000)
    rows = quality.judged(documents(list(enumerate(texts)))).collect()
    found = {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows
    }
    assert found == {i: base(t) for i, t in enumerate(texts)}
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def lines(n):
    return "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) + "." for i in range(n))


def test_line_rules(spark, documents):
    nav = "Home | News | Sport | Contact | About."
    symbols = "one### two$$$ three%%% four&&& five***."
    stock = "Please accept all cookies to go on."
    rows = [
        (1, lines(6)),
        (2, lines(6) + "\n" + nav + "\n" + symbols + "\n" + stock + "\nno end of a sentence"),
        (3, "\n".join([nav] * 1 + ["a | b | c | d" + str(i) for i in range(20)])),
        (4, None),
        (5, "NOW!! BUY!! THIS!! " * 20 + "."),
    ]
    found = {r.doc_id: r.kept for r in quality.judged(documents(rows)).collect()}
    assert found == {1: True, 2: True, 3: False, 4: False, 5: False}
    frame = documents(rows)
    kept = quality.cleaned(frame)
    assert kept.columns == frame.columns
    out = {r.doc_id: r for r in kept.collect()}
    assert set(out) == {1, 2} and out[1].text == lines(6) and out[2].text == lines(6)
    assert out[2].n_chars == len(lines(6)) and out[2].h == "2" and out[2].gone


def test_native_plan(spark, documents):
    for frame in (quality.judged(documents([])), quality.cleaned(documents([]))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
        assert frame.collect() == []
