"""Plain Python forms of the operators' contracts, for small inputs."""

import re
from collections import defaultdict

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in FORMS for m in re.finditer(FORMS[k], text or "") if valid(k, m.group())]


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_components(rows):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d in sorted(sets):
        common = defaultdict(int)
        for g in sets[d]:
            for o in holders[g]:
                common[o] += 1
            holders[g].append(d)
        for o, n in common.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items):
    w, hit, found = words(text), set(), set()
    for item, item_text in items:
        v = words(item_text)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


SENTENCE_END = r"(?<=[.!?])(?=[\x20\x09])|(?<=[。！？])(?=[^\n])"


def line_messages(text, least_tokens=3):
    """(pos, part, at, tokens) of a text's sentences and of its lines of several."""
    out, at = [], 0
    for pos, row in enumerate((text or "").split("\n") if text is not None else []):
        parts = re.split(SENTENCE_END, row)
        split = lambda x: tuple("<*>" if re.search("[0-9]", w) else w for w in re.split(r"[\x20\x09-\x0D]+", x) if w)
        for j, part in enumerate(parts):
            if split(part):
                out.append((pos, -1 if len(parts) == 1 else j, at, split(part)))
                at += 1
        if len(parts) > 1 and len(split(row)) >= least_tokens:
            out.append((pos, -1, None, split(row)))
    return out


def line_tree(lines, same, constant):
    """line -> template of a leaf's distinct lines, or nothing for those that fit none."""
    found, pending = {}, [("", sorted(lines))]
    while pending:
        name, node = pending.pop()
        if len(node) < 2:
            continue
        counts = [defaultdict(int) for _ in node[0]]
        for line in node:
            for k, token in enumerate(line):
                counts[k][token] += 1
        fixed = [(k, t) for k, c in enumerate(counts) for t, n in c.items() if n > 1 and n >= same * len(node)]
        rest = node
        if fixed and len(fixed) >= constant * len(node[0]):
            rest = [x for x in node if any(x[k] != t for k, t in fixed)]
            found.update({x: (name, tuple(fixed)) for x in node if x not in rest})
        ranks = []
        for k, c in enumerate(counts):
            some = [n for n in c.values() if 1 < n < len(node)]
            if some:
                ranks.append((sum(some), -len(some), -k))
        if ranks and rest:
            k = -max(ranks)[2]
            for token in {x[k] for x in rest}:
                pending.append((f"{name}/{k}={token}", [x for x in rest if x[k] == token]))
    return found


def recurring(docs, leading=3, same=0.9, constant=0.7, least_general=6):
    """(id, pos, part, at, n, n_docs, first) of messages whose template occurs in two documents; ids are distinct."""
    rows = [(d, *m) for d, text in docs for m in line_messages(text)]
    leaves = defaultdict(set)
    for _, _, _, _, tokens in rows:
        if len(tokens) >= least_general:
            leaves[len(tokens), tokens[:leading]].add(tokens)
    owners = defaultdict(set)
    for d, _, _, _, tokens in rows:
        owners[len(tokens), tokens[:leading]].add(d)
    template = {}
    for leaf, lines in leaves.items():
        if len(owners[leaf]) > 1:
            template.update({x: (leaf, t) for x, t in line_tree(lines, same, constant).items()})
    of = defaultdict(set)
    for d, _, _, _, tokens in rows:
        of[template.get(tokens, tokens)].add(d)
    out = []
    for d, pos, part, at, tokens in rows:
        docs_of = of[template.get(tokens, tokens)]
        if len(docs_of) > 1:
            out.append((d, pos, part, at, len(tokens), len(docs_of), d == min(docs_of)))
    return out
