"""Plain-Python forms of the ordered operators, used to check the DataFrame forms."""

from __future__ import annotations


def jaccard(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


def merge_in_order(rows):
    """rows: (ord, label, text, domain, category) -> {(label, ord): first ord of its node}."""
    nodes, out = [], {}
    for ord_, label, text, domain, category in sorted(rows):
        words = set(text.lower().split())
        for n in nodes:
            other = set(n["text"].lower().split())
            same = bool(words and other) and 5 * len(words & other) > 3 * len(words | other)
            if n["label"] != label or not same:
                continue
            if label == "CoreBelief" and n["category"] and category and n["category"] != category:
                continue
            break
        else:
            n = {"label": label, "head": ord_, "domain": None, "category": None}
            nodes.append(n)
        n["text"] = text
        n["domain"] = domain or n["domain"]
        n["category"] = category or n["category"]
        if label == "CoreBelief" and n["domain"] != "self":
            n["category"] = None
        out[(label, ord_)] = n["head"]
    return out


def fold_props(rows, label):
    """rows: (ord, props) in order, gated after every step -> final props."""
    gates = {"CoreBelief": ("category", "domain", "self"), "Reaction": ("valence", "channel", "emotional"),
             "Intervention": ("techniqueLabel", "technique", "other")}
    props = {}
    for _, p in sorted(rows, key=lambda r: r[0]):
        props.update({k: v for k, v in p.items() if v})
        if label in gates:
            prop, key, value = gates[label]
            if props.get(key) != value:
                props.pop(prop, None)
        if label == "AutomaticThought":
            props.setdefault("modality", "verbal")
        if label == "Homework":
            props.setdefault("isOptional", "false")
    return props


def bisect_chunks(lengths, budget, overlap):
    """lengths: characters per rendered turn -> [(lo, hi)] in reading order."""
    size = lambda lo, hi: sum(lengths[lo:hi]) + (hi - lo - 1)
    todo, done = [(0, len(lengths))], []
    while todo:
        lo, hi = todo.pop(0)
        n = hi - lo
        if size(lo, hi) <= budget or n <= 2 * overlap + 1:
            done.append((lo, hi))
            continue
        mid = n // 2
        todo[:0] = [(lo, min(lo + mid + overlap, hi)), (lo + max(0, mid - overlap), hi)]
    return done


def phases(turns, found):
    """turns: [(turn, model index or -1)], found: {class: first turn} -> phase index per turn."""
    need = {1: (["Problem"], 2), 2: (["AutomaticThought", "Situation"], 5), 3: (["AdaptiveResponse"], 12)}
    cur, out = 0, {}
    for t, model in sorted(turns):
        want = max(min(cur + 1, 3), model)
        if want > cur:
            classes, least = need[want]
            if t >= least and all(found.get(c, 10 ** 9) <= t for c in classes):
                cur = want
        out[t] = cur
    return out


def trace(starts, nodes, edges, hops):
    """-> ({node: level}, {walked edge ids}) by level-wise walking; edges: (id, s, o)."""
    level = {n: 0 for n in starts}
    walked, frontier = set(), set(starts)
    for h in range(1, hops + 1):
        new = set()
        for i, s, o in edges:
            if s in frontier and o in nodes:
                walked.add(i)
                if o not in level:
                    level[o] = h
                    new.add(o)
        if not new:
            break
        frontier = new
    return level, walked
