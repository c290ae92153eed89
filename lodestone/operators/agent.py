"""Answering from evidence: a digest or a cited answer, and the plan-retrieve-grade loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .findings import parse_reply
from .retrieval import digest

# Evidence kept, evidence that suffices offline, rounds, turns of context.
MAX_EVIDENCE = 24
ENOUGH = 3
MAX_ROUNDS = 2
MAX_TURNS = 4
STREAMS = ("code", "doc", "commit", "issue")

Search = Callable[[str, list[str] | None], list[dict]]
Model = Callable[[str], str]


def merge_evidence(old: list[dict], new: list[dict]) -> list[dict]:
    """Evidence once for each stream, citation and title, in order of appearance, capped."""
    seen: dict[tuple, dict] = {}
    for e in [*old, *new]:
        seen.setdefault((e.get("stream"), e.get("citation"), e.get("title")), e)
    return list(seen.values())[:MAX_EVIDENCE]


def context(history: list[dict]) -> str:
    """The last turns as text."""
    return "\n\n".join(f"Q: {h['question']}\nA: {h.get('answer', '')}" for h in history[-MAX_TURNS:] if h.get("question"))


def ask(question: str, search: Search, model: Model | None = None, history: list[dict] | None = None) -> dict:
    """An answer with its evidence; a digest of the evidence without a model."""
    evidence = search(question, None)
    if not evidence or model is None:
        return {"answer": digest(evidence), "evidence": evidence, "offline": model is None}
    return {"answer": model("\n\n".join([digest(evidence), context(history or []), question])), "evidence": evidence, "offline": False}


def investigate_steps(question: str, search: Search, model: Model | None = None, expand: Callable[[list[str]], list[dict]] | None = None, rounds: int = MAX_ROUNDS, history: list[dict] | None = None) -> Iterator[dict]:
    """The loop's states one after the other: plan, retrieve, grade (and again), answer."""
    state = {"question": question, "queries": [question], "streams": list(STREAMS), "targets": [], "evidence": [], "round": 0, "enough": False}
    if model is not None:
        plan = parse_reply(model(f"plan\n{context(history or [])}\n{question}"))
        queries = [str(q) for q in plan.get("queries") or [] if str(q).strip()]
        state |= {"queries": queries or [question], "streams": [s for s in plan.get("streams") or [] if s in STREAMS] or list(STREAMS), "targets": [str(t) for t in plan.get("graph_targets") or []]}
    yield {"step": "plan", **state}
    while True:
        found = [e for q in state["queries"] for e in search(q, state["streams"])]
        if expand is not None and state["targets"]:
            found += expand(state["targets"])
        state |= {"evidence": merge_evidence(state["evidence"], found), "round": state["round"] + 1}
        yield {"step": "retrieve", **state}
        if model is None:
            state |= {"enough": len(state["evidence"]) >= ENOUGH, "queries": []}
        else:
            grade = parse_reply(model(f"grade\n{digest(state['evidence'])}\n{question}"))
            state |= {"enough": bool(grade.get("sufficient")), "queries": [str(q) for q in grade.get("queries") or [] if str(q).strip()]}
        yield {"step": "grade", **state}
        if state["enough"] or not state["queries"] or state["round"] >= rounds:
            break
    answer = digest(state["evidence"]) if model is None else model(f"answer\n{digest(state['evidence'])}\n{question}")
    yield {"step": "answer", **state, "answer": answer}


def investigate(question: str, search: Search, model: Model | None = None, **options) -> dict:
    """The loop's last state."""
    last: dict = {}
    for last in investigate_steps(question, search, model, **options):
        pass
    return last


def fact_card(name: str, dependents: list[str], path: list[tuple[int, str]], limit: int = 15) -> dict:
    """What depends on a symbol and what it leads to, as one piece of evidence."""
    body = f"{name}: used by {', '.join(dependents[:limit]) or 'nothing'}; leads to {', '.join(n for _, n in path[:limit]) or 'nothing'}"
    return {"stream": "code", "citation": name, "title": "dependencies", "body": body}
