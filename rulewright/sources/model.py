"""Model endpoints as a batched source; a deterministic mock is the only backend here."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from rulewright.sources.resume import append_pending

REPLIES = "problem_id string, sample_idx int, raw string, finish string, prompt_tokens int, completion_tokens int, latency_s double, n_tries int, error string"


def mock_backend(prompt: str, seed: int) -> str:
    """Always the same reply to the same prompt and seed."""
    h = hashlib.sha256(f"{seed}|{prompt}".encode()).hexdigest()
    return f"NEW RULES:\np{h[:2]}(X) :- q{h[2:4]}(X).\n\nNEW ASSUMPTIONS:\nNONE"


def wait_of(message: str, default: float) -> float:
    """Seconds that a refusal such as `try again in 1m2.5s` asks for."""
    m = re.search(r"try again in\s+((?:[0-9.]+(?:h|ms|m|s))+)", message)
    seconds = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001}
    total = sum(float(v) * seconds[u] for v, u in re.findall(r"([0-9.]+)(ms|h|m|s)", m[1])) if m else 0.0
    return total or default


def generate(prompts: DataFrame, backend: Callable[[str, int], str] = mock_backend, retries: int = 2, min_interval: float = 0.0, max_wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """prompts (problem_id, sample_idx, prompt, seed) -> one reply row for each.

    Calls of a task are at least min_interval seconds apart; a failing call is tried again after the wait that its message
    asks for (doubling from a second where it asks for none), and gives an error row after `retries` more tries or where the
    wait exceeds max_wait.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = 0.0
        for batch in batches:
            rows = []
            for pid, i, prompt, seed in zip(batch["problem_id"], batch["sample_idx"], batch["prompt"], batch["seed"], strict=True):
                raw, error, tries, took = None, None, 0, 0.0
                while raw is None and tries <= retries:
                    if (early := last + min_interval - time.monotonic()) > 0:
                        sleep(early)
                    last = began = time.monotonic()
                    tries += 1
                    try:
                        raw, error = backend(prompt, int(seed)), None
                    except Exception as e:  # noqa: BLE001  reported in the row
                        error = f"{type(e).__name__}: {e}"
                        wait = wait_of(str(e), 2.0 ** (tries - 1)) if tries <= retries else 0.0
                        if wait > max_wait:
                            break
                        if wait and min_interval:
                            sleep(wait)
                    took = time.monotonic() - began
                rows.append((pid, i, raw, "stop" if raw is not None else "error", len(prompt.split()), len((raw or "").split()), took, tries, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPLIES.split(", ")])

    return prompts.select("problem_id", "sample_idx", "prompt", "seed").mapInPandas(work, REPLIES)


def run_modes(prompts: DataFrame, modes: list[str], path: str, backend: Callable[[str, int], str] = mock_backend) -> dict[str, int]:
    """New reply rows of each mode, appended to path/mode=<mode>; a mode that fails is skipped (-1), rows of another run are refused.

    prompts: (mode, problem_id, sample_idx, prompt, seed). A run into the same path goes on where the last one stopped.
    """
    done: dict[str, int] = {}
    for mode in modes:
        own = prompts.where(prompts["mode"] == mode)
        try:
            rows = generate(own, backend).join(own.select("problem_id", "sample_idx", "seed"), ["problem_id", "sample_idx"]).drop("latency_s")
            done[mode] = append_pending(rows, f"{path}/mode={mode}", ["problem_id", "sample_idx"], ["seed"])
        except ValueError:
            raise
        except Exception:  # noqa: BLE001  another mode may still run; the count tells
            done[mode] = -1
    return done
