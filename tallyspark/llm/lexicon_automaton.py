"""A lexicon trie intersected with Levenshtein automata, made deterministic as words come."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Distance allowed for a word, by its least length, and how much longer a stem must be, as anything may
#: follow it; shorter ones must match exactly.
EDITS, STEM_MORE = ((10, 2), (5, 1)), 2


def allowed_edits(term: str) -> int:
    size = len(term) - 1 - STEM_MORE if term.endswith("*") else len(term)
    return next((k for least, k in EDITS if size >= least), 0)


@dataclass
class _Node:
    children: dict[str, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (term, edits spent on a swap)
    budget: int = 0  # most edits that a term below may take


class LexiconAutomaton:
    """Finds the lexicon term nearest to a word. A term that ends in `*` is a stem: anything may follow.

    A state is the set of trie nodes that some edits of the word read so far lead to, each with the
    fewest edits, as the Levenshtein automata of all terms run at once over the shared trie. States
    and steps are made when first needed and kept, so a word costs one dictionary look-up for each
    letter until no term can match any more. `edits` limits each term, by its length unless given. Swaps of neighbouring letters count as one edit."""

    def __init__(self, terms: list[str], edits: list[int] | None = None) -> None:
        self.terms = terms
        self.edits = [allowed_edits(t) for t in terms] if edits is None else edits
        self.nodes = [_Node()]
        for t, term in enumerate(terms):
            k = self.edits[t]
            plain = term.removesuffix("*")
            self._add(plain, t, 0, k)
            if k:
                for i in range(len(plain) - 1):
                    swapped = plain[:i] + plain[i + 1] + plain[i] + plain[i + 2 :]
                    if swapped != plain:
                        self._add(swapped, t, 1, k)
        self.steps: list[dict[str, int]] = []
        self.finals: list[tuple[int, int] | None] = []
        self.states: dict[tuple, int] = {}
        self.contents: list[tuple] = []
        self.dead = self._state({}, None)
        self.start = self._state(self._closed({0: 0}), None)

    def _add(self, text: str, term: int, spent: int, k: int) -> None:
        at = 0
        self.nodes[0].budget = max(self.nodes[0].budget, k)
        for char in text:
            if char not in self.nodes[at].children:
                self.nodes[at].children[char] = len(self.nodes)
                self.nodes.append(_Node())
            at = self.nodes[at].children[char]
            self.nodes[at].budget = max(self.nodes[at].budget, k)
        self.nodes[at].ends.append((term, spent))

    def _closed(self, front: dict[int, int]) -> dict[int, int]:
        """With all nodes that letters missing in the word lead to."""
        todo = list(front.items())
        while todo:
            node, edits = todo.pop()
            if front.get(node, 99) < edits:
                continue
            for child in self.nodes[node].children.values():
                if edits + 1 <= self.nodes[child].budget and edits + 1 < front.get(child, 99):
                    front[child] = edits + 1
                    todo.append((child, edits + 1))
        return front

    def _found(self, front: dict[int, int], stems: bool) -> tuple[int, int] | None:
        """(edits, term) of the nearest term that ends here."""
        best = None
        for node, edits in front.items():
            for term, spent in self.nodes[node].ends:
                text = self.terms[term]
                if text.endswith("*") >= stems and edits + spent <= self.edits[term] and (best is None or (edits + spent, term) < best):
                    best = (edits + spent, term)
        return best

    def _state(self, front: dict[int, int], stem: tuple[int, int] | None) -> int:
        here = self._found(front, stems=True)
        stem = min((x for x in (stem, here) if x), default=None)
        key = (frozenset(front.items()), stem)
        if key not in self.states:
            self.states[key] = len(self.steps)
            self.steps.append({})
            self.contents.append((front, stem))
            whole = self._found(front, stems=False)
            self.finals.append(min((x for x in (stem, whole) if x), default=None))
        return self.states[key]

    def _step(self, state: int, char: str) -> int:
        front, stem = self.contents[state]
        after: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.nodes[node].budget and edits < after.get(node, 99):
                after[node] = edits

        for node, edits in front.items():
            reach(node, edits + 1)  # a letter too many
            for letter, child in self.nodes[node].children.items():
                reach(child, edits + (letter != char))
        return self._state(self._closed(after), stem)

    def look_up(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term), or None if no term is near enough."""
        state = self.start
        for char in word:
            following = self.steps[state].get(char)
            if following is None:
                following = self.steps[state][char] = self._step(state, char)
            state = following
            if state == self.dead:
                return None
        return self.finals[state]
