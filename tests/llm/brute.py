"""Plain single-process versions of the corpus operators' contracts."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import xxhash


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    """The smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def near_fingerprints(fps, most=4):
    fps = np.array(sorted(fps), dtype=np.uint64)
    found = []
    for i, f in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ f) <= most)
        found += [(int(f), int(fps[i + 1 + j])) for j in near]
    return found


def simhash_rows(rows):
    """doc_id, fingerprint, component_id of rows (doc_id, text) with distinct ids."""
    fps = {i: fingerprint(t) for i, t in rows}
    label = components(set(fps.values()), near_fingerprints(set(fps.values())))
    least = {}
    for i, f in fps.items():
        least[label[f]] = min(i, least.get(label[f], i))
    return {(i, f"{f:016x}", least[label[f]]) for i, f in fps.items()}


def bpe_rows(rows, path, pattern):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = set()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, dtype="<u4").tobytes()
        out.add((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
    return out


def token_rows(rows, path, end_id=2):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out, start = set(), 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, end_id]
        out.add((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def vector_rows(rows, least=0.93):
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding, label) with distinct ids."""
    good = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((label, len(v)), []).append((i, np.array(v, dtype=np.float64)))
    links = []
    for group in good.values():
        ids = [i for i, _ in group]
        unit = np.array([v for _, v in group])
        unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(unit @ unit.T >= least, 1))
        links += [(ids[x], ids[y]) for x, y in zip(a.tolist(), b.tolist())]
    label = components([r[0] for r in rows], links)
    count = dict.fromkeys(label, 0)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {(i, count[i], label[i], label[i] == i) for i in label}, links


def base_spans(text):
    """kind, start and end of the base personal data of a text, by the contract's plain patterns."""
    text = text or ""

    def luhn(d):
        return sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def base_row(ident, text):
    found = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
    return (ident, *[sum(f[0] == k for f in found) for k in ("email", "ip", "card", "phone")], hashlib.sha256(joined.encode()).hexdigest())


def votes(kind, match, before, pii):
    """The labelers' votes on a candidate of an added kind, written plainly."""
    digits = re.sub("[^0-9]", "", match)
    one = lambda good: 1 if good else -1
    gazetteer = 0
    if kind == "phone_local":
        shape = one(digits[0] in "23456789" and digits[3] in "23456789")
    elif kind == "ssn":
        shape = one(not (match[:3] in ("000", "666") or match[0] == "9" or match[4:6] == "00" or match[7:] == "0000"))
    elif kind == "iban":
        shape, gazetteer = one(15 <= len(match.replace(" ", "")) <= 34), one(match[:2] in pii.IBAN_COUNTRIES)
    elif kind == "person":
        words = match.split(" ")
        shape, gazetteer = int(len(words) == 3), int(words[1].lower() in pii.GIVEN_NAMES)
    elif kind == "secret":
        share = len(digits) / len(match)
        mixed = re.fullmatch("[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}", match) or re.search("[A-Z].*[0-9].*[a-z]|[0-9].*[A-Za-z].*[0-9].*[A-Za-z]", match)
        shape = one(0.08 <= share <= 0.9 and len(match) >= 20 and not re.fullmatch("[0-9+-]+", match) and mixed)
        gazetteer = int(bool(re.search(pii.SECRET_PREFIXES, match)))
    else:
        ends = re.search("[A-Za-z]+$", match)
        shape, gazetteer = one(re.search("[A-Za-z]{2,6}$", match)), int(bool(ends) and ends[0].lower() in pii.TOP_DOMAINS)
    near = lambda words: bool(re.search(r"\b(?:" + "|".join(words.split()) + ")", before, re.I | re.A))
    return {"shape": shape, "gazetteer": gazetteer, "context": int(near(pii.FOR[kind])), "against": -int(near(pii.AGAINST))}


def token_count_rows(rows, path, limit):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {(i, len((t or "").encode()), n, n > limit) for (i, t), n in zip(rows, (len(model.encode(t or "")) for _, t in rows))}


def damage(rows):
    """conv_id, turn, role, text after the contract's damage."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repair(turns):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 of one conversation's turns (turn, role, text) in order.

    Keeps the cheapest and then least edits to reach each string of states,
    the language written as a table of its own.
    """
    seen, faults = set(), []
    for _, role, text in turns:
        shown = text.rstrip("\x20\t\n\x0b\f\r")
        fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for i, name in (("u", "user"), ("a", "assistant")):
                    to = goes.get((state, i))
                    if to:
                        best[to] = min(best.get(to, (10**9,)), (cost + 3, audit + "I", (*out, (name, ""))))
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(turns, faults):
        after = {}

        def offer(state, *found):
            after[state] = min(after.get(state, (10**9,)), found)

        for state, (cost, audit, out) in best.items():
            offer(state, cost + 4, audit + "D", out)
            if fault in "bd" and fault:
                continue
            extra = 3 * (fault == "t")
            if (state, role[:1]) in goes:
                offer(goes[state, role[:1]], cost + extra, audit + "K", (*out, (role, text)))
            for i, name in (("u", "user"), ("a", "assistant")):
                if (state, i) in goes:
                    offer(goes[state, i], cost + 3 + extra, audit + "R", (*out, (name, text)))
        best = inserted(after)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest), out


def turn_order(rows):
    """Rows (turn, role, text) in order: nulls first, ties by role and by digest."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return sorted(rows, key=key)


def conversation_rows(rows):
    """The contract's rows of conversations (conv_id, turn, role, text)."""
    by = {conv: [] for conv, *_ in rows}
    for conv, *row in damage(rows):
        by[conv].append(tuple(row))
    return {(conv, *repair(turn_order(own))[0]) for conv, own in by.items()}


def collocation_rows(rows, least, most):
    """The contract's phrases of rows (lang, text)."""
    from collections import Counter

    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    often = {key: f for key, f in counts.items() if f >= least}
    inside = {}
    for (lang, words), f in often.items():
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                if j - i < len(words):
                    inside[lang, words[i:j]] = max(f, inside.get((lang, words[i:j]), 0))
    by = {}
    for (lang, words), a in often.items():
        if len(words) > 1 and inside.get((lang, words), 0) < a:
            cuts = [(often[lang, words[:k]], often[lang, words[k:]]) for k in range(1, len(words))]
            score, _, left, right = min((1000 * a * totals[lang] // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            by.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, found in by.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1)
    }
