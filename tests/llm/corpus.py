"""A small corpus with every awkward case, and plain versions of the operators."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, chunk string, body int, n_words int"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text: str | None) -> list[str]:
    return words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def documents(n: int = 120, seed: int = 3) -> list[tuple]:
    """Rows of SCHEMA: near and exact copies, shared passages, nulls, white texts, one very long text, repeated rows, a hot source, clashing extra columns."""
    rng = random.Random(seed)
    vocab = {"en": ["the", "ing", "house", "tion", "with", "that", "whole", "street", "then", "under"], "de": ["und", "der", "schön", "straße", "über", "nicht", "haus", "kind", "wäre", "größe"]}
    passage = " ".join(f"shared{i}" for i in range(70))
    rows: list[tuple] = []

    def text(lang: str, k: int) -> str:
        out = []
        for i in range(k):
            out.append(rng.choice(vocab[lang]) + rng.choice(vocab[lang]) * rng.randint(0, 2))
            if i % 11 == 10:
                out[-1] += rng.choice([".", ".\n", ",", "!"])
        return " ".join(out)

    for i in range(n):
        lang = "en" if i % 3 else "de"
        t = text(lang, rng.choice([3, 5, 12, 60, 90, 200]))
        if i % 7 == 0:
            t = t + " " + passage + "\n" + text(lang, 5)
        if i % 10 == 4 and len(rows) > 5:
            base = rows[rng.randrange(len(rows))][1] or "x"
            w = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
            t = " ".join(w)
        rows.append((i, t, lang, "hot" if i % 3 else f"s{i % 5}", len(t), "x", "y", 1, 2))
    extra = [(None, None, None, None), (n, None, "en", "hot"), (n + 1, "", "en", None), (n + 2, " \n\t ", "de", "hot"), (n + 3, text("en", 5000), "en", "hot"), (n + 4, "12 ### 34", None, "s1"), (n + 5, "One", "en", "s1"), (n + 6, "one", "en", "s1"), (n + 7, "A" * 3000 + " b", "en", "s2"), (n + 8, "it's the <|endoftext|> of  it\r\n", "en", "s2")]
    rows += [(i, t, l, s, len(t or ""), "x", None, None, None) for i, t, l, s in extra]
    return rows + rows[:6] + [rows[9]] * 20


def repeated_cover(texts: list[str | None], k: int) -> list[list[bool]]:
    """Which words lie in a window of k words that starts twice or more."""
    ws = [words(t) for t in texts]
    c = Counter(tuple(w[p : p + k]) for w in ws for p in range(len(w) - k + 1))
    out = []
    for w in ws:
        cut = [False] * len(w)
        for p in range(len(w) - k + 1):
            if c[tuple(w[p : p + k])] > 1:
                cut[p : p + k] = [True] * k
        out.append(cut)
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    w = lowered(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(rows: list[tuple]) -> list[tuple]:
    """(doc_id, set size, component) of each row by comparing all pairs."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in by[x] if j < i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]
