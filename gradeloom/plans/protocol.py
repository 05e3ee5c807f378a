"""How a file is graded: pipeline and knobs by precedence option > dataset > default. Driver-side only."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

STAGES = ("exact-match", "rule-match", "llm-match", "llm-judge", "vqa-accuracy", "anls")
LLM_STAGES = frozenset({"llm-match", "llm-judge"})
GRADERS = frozenset({"vqa-accuracy", "anls"})
STRING_MATCHES = ("exact", "contains", "anls")
DEFAULTS = {"score_pipeline": "exact-match", "numeric_rel_tol": 0.0, "numeric_abs_tol": 0.0, "string_match": "exact", "anls_threshold": 0.5}


class ProtocolError(ValueError):
    """A declaration that can't be run."""


def parse_pipeline(spec: str | Sequence[str], where: str = "pipeline") -> list[str]:
    """Stage names of a comma-separated text or a list: known, not twice, a grader only last."""
    if not isinstance(spec, (str, list, tuple)):
        raise ProtocolError(f"{where}: stages must be a text or a list, not {type(spec).__name__}")
    names = [s for s in (str(x).strip() for x in (spec.split(",") if isinstance(spec, str) else spec)) if s]
    problem = (
        "no stages" if not names
        else f"unknown stages {bad}" if (bad := [s for s in names if s not in STAGES])
        else "a stage occurs twice" if len(set(names)) < len(names)
        else "a grader decides every row and must be last" if GRADERS & set(names[:-1])
        else ""
    )
    if problem:
        raise ProtocolError(f"{where}: {problem}; known stages are {', '.join(STAGES)}")
    return names


@dataclass(frozen=True)
class Protocol:
    """What is run, where each knob came from, and whether it is the dataset's own protocol (None: none declared)."""

    pipeline: tuple[str, ...]
    numeric_rel_tol: float = 0.0
    numeric_abs_tol: float = 0.0
    string_match: str = "exact"
    anls_threshold: float = 0.5
    task_type: str | None = None
    official: bool | None = None
    notes: tuple[str, ...] = ()
    sources: Mapping[str, str] = field(default_factory=dict)

    def fingerprint(self, **more: object) -> str:
        """A digest of all that changes verdicts; judge settings (judge_model, judge_model_revision, ...) count only with a judging
        stage. Name the data, too: dataset_name, subset, split and, where there is one, dataset_revision."""
        judge = more if LLM_STAGES & set(self.pipeline) else {k: v for k, v in more.items() if not k.startswith("judge_")}
        told = [self.pipeline, self.numeric_rel_tol, self.numeric_abs_tol, self.string_match, self.anls_threshold, sorted(judge.items())]
        return hashlib.sha256(json.dumps(told, default=str).encode()).hexdigest()


def one_meta(metas: Sequence[Mapping | None]) -> dict | None:
    """The only distinct dataset block; several are refused."""
    distinct = {json.dumps(m, sort_keys=True): dict(m) for m in metas if m}
    if len(distinct) > 1:
        raise ProtocolError(f"{len(distinct)} different dataset blocks in one file")
    return next(iter(distinct.values()), None)


def resolve_protocol(options: Mapping[str, object] | None = None, meta: Mapping | None = None, defaults: Mapping[str, object] = DEFAULTS) -> Protocol:
    """options holds what was given explicitly. A dataset may declare a stage list, [] (no official protocol) or
    {"unsupported": name, "reason": text}, which is refused unless a pipeline is given."""
    options, meta = dict(options or {}), dict(meta or {})
    if "score_type" in meta:
        raise ProtocolError("score_type is no longer a declaration; use score_pipeline")
    declared, params = meta.get("score_pipeline"), meta.get("score_params") or {}
    notes: list[str] = []
    if isinstance(declared, Mapping) and "unsupported" not in declared or declared is not None and not isinstance(declared, (Mapping, list, tuple)):
        raise ProtocolError("score_pipeline must be a list of stages or name an unsupported protocol")
    refused = declared if isinstance(declared, Mapping) else None
    own = parse_pipeline(declared, "dataset") if isinstance(declared, (list, tuple)) and declared else None

    sources = {"score_pipeline": "option" if "score_pipeline" in options else "dataset" if own else "default"}
    if "score_pipeline" in options:
        pipeline = parse_pipeline(options["score_pipeline"], "option")  # type: ignore[arg-type]
        if refused is not None:
            notes.append(f"overrides the unsupported protocol {refused['unsupported']}: approximate")
        elif own and own != pipeline:
            notes.append(f"overrides the declared pipeline {own}: not comparable")
    elif refused is not None:
        raise ProtocolError(f"the official protocol {refused['unsupported']} is unsupported: {refused.get('reason', 'no reason given')}")
    else:
        pipeline = own or parse_pipeline(defaults["score_pipeline"], "default")  # type: ignore[arg-type]

    def knob(name: str, *spellings: str):
        for source, found, keys in (("option", options, (name,)), ("dataset", params, spellings or (name,))):
            for key in keys:
                if found.get(key) is not None:
                    sources[name] = source
                    return found[key]
        sources[name] = "default"
        return defaults[name]

    rel, absolute, text = float(knob("numeric_rel_tol")), float(knob("numeric_abs_tol")), str(knob("string_match"))
    threshold = float(knob("anls_threshold", "threshold", "anls_threshold"))
    if text not in STRING_MATCHES:
        raise ProtocolError(f"string_match {text!r} is not one of {STRING_MATCHES}")
    if params.get("rubric") not in (None, "", "binary"):
        notes.append(f"rubric {params['rubric']} is judged as right or wrong only")
    if declared is None:
        official = None
    elif declared in ([], ()):
        official = False
        notes.append("the dataset has no official protocol")
    else:
        official = not (sources["score_pipeline"] == "option" and (refused is not None or pipeline != own))
    if str(meta.get("score_note") or "").strip():
        notes.append(str(meta["score_note"]).strip())
    return Protocol(tuple(pipeline), rel, absolute, text, threshold, meta.get("task_type"), official, tuple(notes), sources)


def provenance() -> dict[str, str | None]:
    """What a run can be repeated with: the versions of Python, Spark and this package's commit, if it is a checkout."""
    import platform
    import subprocess
    from pathlib import Path

    import pyspark

    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, cwd=Path(__file__).parent).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        commit = None
    return {"git_commit": commit, "python": platform.python_version(), "spark": pyspark.__version__}


def each_file(files: Sequence[str], grade_file: Callable[[str], object]) -> tuple[dict[str, object], dict[str, str]]:
    """grade_file() of every file, the failure of one leaving the others alone: results and errors by file."""
    done, failed = {}, {}
    for name in files:
        try:
            done[name] = grade_file(name)
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed


# What a generation call may be told, and another name for one of them in chat interfaces.
GENERATION = (
    "max_length", "max_new_tokens", "min_length", "min_new_tokens", "early_stopping", "max_time", "do_sample", "num_beams", "use_cache", "cache_implementation", "temperature", "top_k", "top_p", "min_p",
    "diversity_penalty", "repetition_penalty", "length_penalty",
)
CHAT_NAMES = {"max_new_tokens": "max_completion_tokens"}


def generation_options(given: Mapping[str, object], defaults: Mapping[str, object] | None = None) -> dict[str, object]:
    """The generation options among what was given, else among the defaults; None counts as not given."""
    found = ((k, given[k] if given.get(k) is not None else (defaults or {}).get(k)) for k in GENERATION)
    return {k: v for k, v in found if v is not None}


def fit_options(options: Mapping[str, object], method: Callable, names: Mapping[str, str] = CHAT_NAMES) -> tuple[dict[str, object], list[str]]:
    """Options under the names that `method` takes, and those that it does not take. All fit where its signature can't be read or
    takes any name."""
    import inspect

    renamed = {k: names.get(k, k) for k in options}
    try:
        known = inspect.signature(method).parameters
    except (TypeError, ValueError):
        known = None
    if known is None or any(p.kind is inspect.Parameter.VAR_KEYWORD for p in known.values()):
        return {renamed[k]: v for k, v in options.items()}, []
    return {renamed[k]: v for k, v in options.items() if renamed[k] in known}, [k for k in options if renamed[k] not in known]
