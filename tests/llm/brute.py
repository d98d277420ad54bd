"""Plain versions of the contracts, one document at a time, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(docs):
    prints = []
    for doc_id, text in docs:
        words = WORD.findall((text or "").translate(UPPER))
        shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        prints.append((doc_id, fp))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, f"{fp:016x}", least.get(find(i))) for i, (d, fp) in enumerate(prints)), key=repr)


def exact(docs):
    groups: dict = {}
    for doc_id, text in docs:
        text = text or ""
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text), []).append((-len(text), doc_id))
    out = []
    for norm, rows in groups.items():
        keep = min(rows)[1]
        out += [(d, keep, len(rows), d == keep, sha(norm)) for _, d in rows]
    return sorted(out)


def repeats(docs, span=35):
    words = [WORD.findall(t or "") for _, t in docs]
    starts = Counter(tuple(w[i:i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if starts[tuple(w[i:i + span])] > 1:
                gone[i:i + span] = [True] * span
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((doc_id, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return sorted(out, key=repr)


def leaks(docs, items, size=10):
    wins: dict = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            wins.setdefault(tuple(w[i:i + size]), set()).add(item)
    lengths = {len(w) for w in wins}
    out = []
    for doc_id, text in docs:
        w = BENCH_WORD.findall((text or "").translate(UPPER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                held = wins.get(tuple(w[i:i + n]))
                if held is not None:
                    hit.update(range(i, i + n))
                    found |= held
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return sorted(out, key=repr)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def pieces(tokenizer, docs, tokens=2048):
    out = []
    for doc_id, text in docs:
        ids = ids_of(tokenizer, text)
        for piece, start in enumerate(range(0, len(ids), tokens)):
            own = ids[start:start + tokens]
            out.append((doc_id, piece, start, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))))
    return sorted(out, key=repr)


def quality(docs):
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of each text."""
    out = []
    for doc_id, text in docs:
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        starts = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if starts[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
        symbols = sum(c in "#*$%&|<>" for c in text)
        out.append((doc_id, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    return sorted(out, key=repr)


def damage(rows):
    """Conversations {conv_id: rows after damage} of (conv_id, turn, role, text) rows."""
    out: dict = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        if kind:
            held += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def repaired(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, sha of one conversation's rows, by whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults, n = set(), [], [0, 0, 0]
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        faults.append(fault)
        if fault:
            n[fault - 1] += 1
    # What may follow what, by the letters of the result so far: empty, s, ...u, ...a.
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for key, (cost, audit, lines) in list(out.items()):
                for c in follows[key].replace("s", ""):
                    better(out, c, (cost + 5, audit + "I", (*lines, ("user" if c == "u" else "assistant") + ":")))
        return out

    for (_, role, text), fault in zip(rows, faults):
        after: dict = {}
        for key, (cost, audit, lines) in inserted(best).items():
            better(after, key, (cost + 2, audit + "D", lines))
            if fault not in (1, 2):
                late = 5 if fault == 3 else 0
                if role[:1] and role[:1] in follows[key]:
                    better(after, role[0], (cost + late, audit + "K", (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if name[0] in follows[key]:
                        better(after, name[0], (cost + 1 + late, audit + "R", (*lines, f"{name}:{text}")))
        best = after
    ends = inserted(best)
    cost, audit, lines = min(ends[k] for k in ("", "a") if k in ends)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return gaps, *n, illegal, cost, audit, sha("\n".join(lines))


def all_edits(rows, faults):
    """Cheapest (cost, audit) by trying every string of edits of a few rows."""
    import itertools

    best = None
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        for edits in itertools.product("DKua", repeat=len(rows)):
            cost, audit, roles = 0, "", [""]
            for i in range(len(rows) + 1):
                for _ in range(inserts[i]):
                    cost, audit, roles = cost + 5, audit + "I", [x + c for x in roles for c in "ua"]
                if i < len(rows):
                    e, fault = edits[i], faults[i]
                    if e != "D" and fault in (1, 2):
                        break
                    audit += e if e in "DK" else "R"
                    cost += {"D": 2, "K": 0}.get(e, 1) + (5 if fault == 3 and e != "D" else 0)
                    if e != "D":
                        roles = [x + (rows[i][1][:1] or "?" if e == "K" else e) for x in roles]
            else:
                if any(re.fullmatch("(s?(ua)+)?", x) for x in roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def phrases(docs, least=30, first=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out: dict = {}
    for (lang, *w), a in often.items():
        around = [b for (other, *x), b in often.items() if other == lang and len(x) > len(w) and any(x[i:i + len(w)] == w for i in range(len(x)))]
        if all(100 * b < 80 * a for b in around):
            cuts = [(2000000 * a // (l + r), k, l, r) for k in range(1, len(w)) for l, r in [(f[lang, *w[:k]], f[lang, *w[k:]])]]
            score, _, l, r = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items() for i, (score, a, p, l, r) in enumerate(sorted(rows)[:first])
    )


def near(pairs):
    """Rows that stay, by comparison of all pairs."""
    sets = []
    for _, text in pairs:
        w = WORD.findall((text or "").translate(UPPER))
        sets.append({" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), (d, i)), (d, i))
    return sorted(-1 if d is None else d for i, (d, _) in enumerate(pairs) if d is None or least[find(i)] == (d, i))
