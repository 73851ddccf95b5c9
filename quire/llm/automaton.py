"""Levenshtein automata with merges and splits, intersected with a vocabulary trie.

The automaton's moves are those of the generalised edit distance: keep a letter,
any single edit, and the recognition confusions in which a short run of letters
is read as another (``rn`` for ``m``). It is never built as a table: a state is
(position in the token, cost so far), and the walk advances it together with a
trie node, so only prefixes that some vocabulary word shares are ever visited.
The result is complete: every vocabulary word within the bound is returned.

An ordinary edit near the root of a trie would open all of its branches. Where the
bound admits only one, it lies in the first or in the second half of the token:
:func:`edited` walks the trie with edits in the second half alone and a trie of the
reversed words with edits in the first, so edits are made only where few branches are left.
"""

from __future__ import annotations

# What a scanner reads (left) for what was printed (right).
CONFUSIONS = [
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("h", "li"), ("li", "h"),
    ("vv", "w"), ("w", "vv"), ("m", "in"), ("in", "m"), ("m", "ni"), ("nn", "m"), ("tn", "m"), ("ni", "m"),
    ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("0", "o"), ("9", "g"), ("5", "s"), ("8", "b"), ("6", "b"),
    ("6", "g"), ("2", "z"), ("q", "g"), ("g", "q"), ("a", "o"), ("o", "a"), ("s", "5"), ("o", "0"), ("l", "1"),
    ("u", "n"), ("n", "u"), ("v", "y"), ("y", "v"), ("tt", "u"), ("fi", "h"), ("ll", "u"), ("lc", "k"),
    ("k", "lc"), ("rri", "m"), ("iii", "m"), ("ü", "ii"), ("ß", "b"), ("б", "6"), ("п", "л"), ("л", "п"),
]
#: Confusions that fonts make easy cost less than the bare shape twins after them.
COMMON = 44
STEP, RARE_STEP, PLAIN_STEP = 2, 3, 4

Node = dict


def trie(words) -> Node:
    """Nested dictionaries by letter; the word itself sits under the empty key."""
    root: Node = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = word
    return root


def _moves(back: bool = False) -> dict[str, list[tuple[str, str, int]]]:
    by_first: dict[str, list[tuple[str, str, int]]] = {}
    for i, (read, printed) in enumerate(CONFUSIONS):
        if back:
            read, printed = read[::-1], printed[::-1]
        by_first.setdefault(read[0], []).append((read, printed, STEP if i < COMMON else RARE_STEP))
    return by_first


MOVES, MOVES_BACK = _moves(), _moves(back=True)


def reach(bound: int, plain: bool = False) -> tuple[int, int]:
    """(shorter, longer): how many letters shorter and longer than the token a word within the bound can be."""
    steps = [(len(read) - len(printed), step) for moves in MOVES.values() for read, printed, step in moves]
    steps += [(1, PLAIN_STEP), (-1, PLAIN_STEP)] if plain else []
    down, up = [0] * (bound + 1), [0] * (bound + 1)
    for cost in range(1, bound + 1):
        down[cost], up[cost] = down[cost - 1], up[cost - 1]
        for less, step in steps:
            if step <= cost:
                down[cost] = max(down[cost], down[cost - step] + less)
                up[cost] = max(up[cost], up[cost - step] - less)
    return down[bound], up[bound]


def edited(root: Node, back: Node, token: str, bound: int) -> dict[str, int]:
    """What ``search(root, token, bound, plain=True)`` finds; ``back`` is the trie of the reversed words."""
    if bound >= 2 * PLAIN_STEP:
        return search(root, token, bound, plain=True)
    half = len(token) // 2
    found = search(root, token, bound, plain=True, since=half)
    for word, cost in search(back, token[::-1], bound, plain=True, since=len(token) - half, moves=MOVES_BACK).items():
        word = word[::-1]
        found[word] = min(cost, found.get(word, cost))
    return found


def search(root: Node, token: str, bound: int = 2 * STEP, plain: bool = False, since: int = 0, moves: dict = MOVES) -> dict[str, int]:
    """All vocabulary words within ``bound`` of the token, each with its least cost.

    ``plain`` also admits any single-letter edit at ``PLAIN_STEP``, from position ``since`` of the token on.
    """
    found: dict[str, int] = {}
    n = len(token)
    stack = [(0, root, 0)]
    seen: dict[tuple[int, int], int] = {}
    while stack:
        i, node, cost = stack.pop()
        at = (i, id(node))
        if seen.get(at, bound + 1) <= cost:
            continue
        seen[at] = cost
        if i == n:
            if "" in node:
                word = node[""]
                if cost < found.get(word, bound + 1):
                    found[word] = cost
            if plain and i >= since and cost + PLAIN_STEP <= bound:
                stack += [(i, nxt, cost + PLAIN_STEP) for ch, nxt in node.items() if ch]
            continue
        same = node.get(token[i])
        if same is not None:
            stack.append((i + 1, same, cost))
        for read, printed, step in moves.get(token[i], ()):
            if cost + step <= bound and token.startswith(read, i):
                nxt = node
                for ch in printed:
                    nxt = nxt.get(ch)
                    if nxt is None:
                        break
                if nxt is not None:
                    stack.append((i + len(read), nxt, cost + step))
        if plain and i >= since and cost + PLAIN_STEP <= bound:
            stack.append((i + 1, node, cost + PLAIN_STEP))
            for ch, nxt in node.items():
                if ch:
                    stack.append((i, nxt, cost + PLAIN_STEP))
                    stack.append((i + 1, nxt, cost + PLAIN_STEP))
    return found
