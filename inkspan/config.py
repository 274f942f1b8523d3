"""Settings as frozen dataclasses, read from YAML with `a.b=value` overrides."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

from .operators.decode import DecodeConfig


@dataclass(frozen=True)
class ExperimentConfig:
    name: str = "inkspan"
    output_dir: str = "outputs"
    seed: int = 42


@dataclass(frozen=True)
class DataConfig:
    dataset_root: str = "."
    labels_txt: str = "labels/labels.txt"
    splits_dir: str = "splits"
    train_split: str = "splits/train.txt"
    val_split: str = "splits/val.txt"
    val_fraction: float = 0.1
    min_score: float = 0.5
    image_size: int = 640
    batch_size: int = 16
    num_workers: int = 4
    pin_memory: bool = True


@dataclass(frozen=True)
class AugmentConfig:
    tier: str = "standard"
    p_rot90: float = 0.75
    p_hflip: float = 0.5
    p_vflip: float = 0.5
    p_color_jitter: float = 0.4
    p_blur: float = 0.15
    p_noise: float = 0.15
    box_jitter_px: float = 0.0
    min_side: float = 2.0


@dataclass(frozen=True)
class TargetConfig:
    shrink_ratio: float = 0.4
    thresh_min: float = 0.3
    thresh_max: float = 0.7
    min_text_size: float = 4.0


@dataclass(frozen=True)
class LossConfig:
    alpha: float = 1.0
    beta: float = 10.0
    ohem_ratio: float = 3.0
    bce_weight: float = 1.0
    dice_weight: float = 1.0
    #: Whether pixels of a text weigh as much as its label's score.
    score_weighting: bool = True


@dataclass(frozen=True)
class TrainerConfig:
    epochs: int = 120
    lr: float = 1e-3
    min_lr: float = 1e-6
    warmup_epochs: int = 3
    ema: bool = True
    ema_decay: float = 0.9995
    log_every: int = 50
    eval_every: int = 1
    save_every: int = 5
    #: Settings of the network's own training, which takes place elsewhere.
    other: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Config:
    """Sections and names are those of the tool's YAML files; `model` and `device` are carried as they are."""

    experiment: ExperimentConfig = field(default_factory=ExperimentConfig)
    data: DataConfig = field(default_factory=DataConfig)
    aug: AugmentConfig = field(default_factory=AugmentConfig)
    target: TargetConfig = field(default_factory=TargetConfig)
    loss: LossConfig = field(default_factory=LossConfig)
    trainer: TrainerConfig = field(default_factory=TrainerConfig)
    postprocess: DecodeConfig = field(default_factory=DecodeConfig)
    model: dict = field(default_factory=dict)
    device: str = "cpu"


def split_args(args: list[str], default: str | None = None) -> tuple[str | None, list[str]]:
    """(path, overrides): the last YAML argument without `=` is the file, the rest are overrides."""
    paths = [a for a in args if "=" not in a and a.endswith((".yaml", ".yml"))]
    return (paths[-1] if paths else default), [a for a in args if "=" in a]


def _merged(old: dict, new: dict) -> dict:
    return old | {k: _merged(old[k], v) if isinstance(v, dict) and isinstance(old.get(k), dict) else v for k, v in new.items()}


def with_values(config: Any, values: dict) -> Any:
    """A copy with the given values; unknown names fail, unless the section has a place for others."""
    known = {f.name: getattr(config, f.name) for f in fields(config)}
    unknown = {k: v for k, v in values.items() if k not in known}
    if unknown and "other" in known:
        values = {k: v for k, v in values.items() if k in known} | {"other": unknown}
    elif unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")

    def cast(old: Any, v: Any) -> Any:
        if is_dataclass(old):
            return with_values(old, v)
        return _merged(old, v) if isinstance(old, dict) else type(old)(v)

    return replace(config, **{k: cast(known[k], v) for k, v in values.items()})


def load(path: str | None = None, overrides: list[str] = ()) -> Config:
    import yaml

    config = with_values(Config(), yaml.safe_load(Path(path).read_text()) or {}) if path else Config()
    for item in overrides:
        name, _, value = item.partition("=")
        nested: Any = yaml.safe_load(value)
        for part in reversed(name.split(".")):
            nested = {part: nested}
        config = with_values(config, nested)
    return config


def dump(config: Config, path: str) -> None:
    """The resolved settings as YAML."""
    import yaml

    Path(path).write_text(yaml.safe_dump(asdict(config), sort_keys=False))
