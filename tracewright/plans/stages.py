"""Stages of a run: what each method is made of, which stages a run takes, and what ran."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame

#: The stages in order.
STAGES = ("base", "sft", "collect", "build", "train", "eval")
#: Pairs, selection and trainer mode of each method.
METHODS = {
    "dpo": ("win_lose", None, "dpo"),
    "rto": ("win_lose+win_win", "reference_relative", "soft_target"),
    "ddo": ("win_lose+win_win", "reference_relative", "soft_target"),
    "tiedpo_rk": ("win_lose+win_win", "reference_relative", "rao_kupper"),
    "tiedpo_dav": ("win_lose+win_win", "reference_relative", "davidson"),
    "divpo_freq": ("win_lose", "action_freq", "dpo"),
    "divpo_prob": ("win_lose", "prob", "dpo"),
    "none": ("", None, ""),
}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class PairConfig:
    """How pairs are built; ranges are checked when made."""

    method: str = "dpo"
    usable: str = "base-alt-alt"
    most_repeats: int = 1
    threshold: float = 0.9
    eta: float = 0.5
    beta: float = 0.1
    pseudo_pairs: bool = False
    max_families: int = 0

    def __post_init__(self):
        rules = {
            "method": self.method in METHODS,
            "usable": self.usable in ("base-alt", "base-alt-alt"),
            "most_repeats": self.most_repeats >= 0,
            "threshold": 0.0 <= self.threshold <= 1.0,
            "eta": 0.0 <= self.eta <= 1.0,
            "beta": self.beta > 0.0,
            "max_families": self.max_families >= 0,
        }
        if bad := [k for k, ok in rules.items() if not ok]:
            raise ConfigError(f"out of range: {', '.join(bad)}")

    @classmethod
    def of(cls, values: dict) -> PairConfig:
        if unknown := sorted(set(values) - {f.name for f in fields(cls)}):
            raise ConfigError(f"unknown: {', '.join(unknown)}")
        return cls(**values)


@dataclass
class Registry:
    """Named parts that can be plugged in."""

    parts: dict[str, Callable] = field(default_factory=dict)

    def add(self, name: str, part: Callable) -> Callable:
        if name in self.parts:
            raise ConfigError(f"{name} is there already")
        self.parts[name] = part
        return part

    def get(self, name: str) -> Callable:
        if name not in self.parts:
            raise ConfigError(f"no {name}; there are {', '.join(sorted(self.parts)) or 'none'}")
        return self.parts[name]


def stages_between(first: str = "base", last: str = "eval") -> list[str]:
    """The stages from first to last."""
    for s in (first, last):
        if s not in STAGES:
            raise ConfigError(f"no stage {s}")
    if STAGES.index(first) > STAGES.index(last):
        raise ConfigError(f"{first} comes after {last}")
    return list(STAGES[STAGES.index(first) : STAGES.index(last) + 1])


#: Of each stage, the section of a configuration that is its own, and what it says of models and of the run.
OWN = {
    "base": ("base", ("expert_model", "expert_base_url"), ("seed", "num_workers", "cuda_visible_devices")),
    "sft": ("sft", ("target_model",), ("seed", "cuda_visible_devices")),
    "collect": ("collection", ("expert_model", "target_model", "expert_base_url", "target_base_url"), ("seed", "num_workers", "cuda_visible_devices")),
    "build": ("dataset", ("target_model", "reference_model"), ("cuda_visible_devices",)),
    "train": ("training", ("target_model", "reference_model"), ("seed", "cuda_visible_devices")),
    "eval": ("evaluation", ("target_model", "target_base_url"), ("cuda_visible_devices",)),
}


def config_of(config: dict, stage: str) -> dict:
    """What of a whole configuration a stage's manifest says; a section or value that is lacking is an error."""
    if stage not in OWN:
        raise ConfigError(f"no stage {stage}")
    section, models, runtime = OWN[stage]
    try:
        benchmark = config["benchmark"]
        pooled = stage != "eval" and benchmark.get("train_task_filters")
        scope = {
            "name": benchmark["name"], "task_scope": benchmark.get("task_group") if pooled else benchmark.get("task_filter"), "task_group": benchmark.get("task_group"), "train_task_filters": benchmark.get("train_task_filters"),
            "evaluation_task_filter": benchmark.get("task_filter") if stage == "eval" else None, "upstream_path": benchmark.get("upstream_path"),
        }
        return {"stage": stage, "benchmark": scope, section: dict(config[section]), "models": {k: config["models"][k] for k in models}, "runtime": {k: config["runtime"][k] for k in runtime}}
    except KeyError as e:
        raise ConfigError(f"the configuration lacks {e.args[0]}") from e


@dataclass
class Runner:
    """Runs stages in order. Each is a registered function from what the stages before gave to a result."""

    registry: Registry = field(default_factory=Registry)
    dry_run: bool = False

    def plan(self, first: str = "base", last: str = "eval") -> list[str]:
        names = stages_between(first, last)
        for n in names:
            self.registry.get(n)
        return names

    def run(self, first: str = "base", last: str = "eval") -> dict:
        """Results by stage, in order; only the plan, with nothing run, in a dry run. An error names its stage."""
        names = self.plan(first, last)
        if self.dry_run:
            return dict.fromkeys(names)
        done: dict = {}
        for n in names:
            try:
                done[n] = self.registry.get(n)(dict(done))
            except Exception as e:
                e.add_note(f"in stage {n}")
                raise
        return done


def manifest(stage: str, config: PairConfig, outputs: dict[str, int]) -> dict:
    """What a stage ran with and how many rows it wrote."""
    return {"stage": stage, "config": asdict(config), "outputs": outputs, "status": "ok"}


#: A model, simulator or tokenizer stands behind a function from and to DataFrames with a key; score distinct keys, then join.
Scorer = Callable[[DataFrame], DataFrame]


def scored(rows: DataFrame, scorer: Scorer, key: list[str], score: str = "score") -> DataFrame:
    """rows with the scorer's column; each distinct key is scored once."""
    return rows.join(scorer(rows.dropDuplicates(key)).select(*key, score), key, "left")
