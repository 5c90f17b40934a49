"""Model providers: a hook that answers prompts.

A provider is a function from a list of prompts to a list of answers, made on the executor by a factory (so that clients and
models are opened there, once for each worker process). Requests are retried, and one that fails leaves its prompt with an error.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.dims import DIMENSIONS
from tallyloom.sources.store import WAVE_ROWS, fill

Provider = Callable[[list[str]], list[str]]


def fixed_answers() -> Provider:
    """A provider without a model: the same grade for every dimension, from the prompt's length. For tests and dry runs."""
    return lambda prompts: [json.dumps({d: 1 + len(p) % 5 for d in DIMENSIONS}) for p in prompts]


def http_provider(url: str, model: str, timeout: float = 120.0, **options) -> Callable[[], Provider]:
    """Factory of a provider that posts {model, prompt, stream: false, options} to url and reads `response`."""

    def make() -> Provider:
        from urllib.request import Request, urlopen

        def ask(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                body = {"model": model, "prompt": p, "stream": False} | ({"options": options} if options else {})
                with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=timeout) as r:
                    out.append(json.load(r).get("response", ""))
            return out

        return ask

    return make


# Fixed value: what a local model is told before the prompt.
STRICT = "You are a strict grading assistant. Return only a JSON object with rubric keys and integer scores."


def local_provider(model: str, max_new_tokens: int = 256, temperature: float = 0.0, top_p: float = 0.9, seed: int | None = None, device: str = "auto") -> Callable[[], Provider]:
    """Factory of a provider that runs a chat model in the task's own process; needs torch and transformers there.

    device "auto" is CUDA where there is any, else the CPU. With temperature 0 the likeliest token is taken each time.
    """

    def make() -> Provider:
        try:
            import torch
            from transformers import AutoModelForCausalLM, AutoTokenizer
        except ImportError as e:
            raise RuntimeError("a local model needs the packages torch and transformers") from e
        place = ("cuda" if torch.cuda.is_available() else "cpu") if device == "auto" else device
        words, net = AutoTokenizer.from_pretrained(model), AutoModelForCausalLM.from_pretrained(model).to(place)
        how = {"do_sample": True, "temperature": temperature, "top_p": top_p} if temperature > 0 else {"do_sample": False}

        def ask(prompts: list[str]) -> list[str]:
            out = []
            for p in prompts:
                if seed is not None:
                    torch.manual_seed(seed)
                asked = words.apply_chat_template([{"role": "system", "content": STRICT}, {"role": "user", "content": p}], tokenize=False, add_generation_prompt=True)
                held = words(asked, return_tensors="pt").to(place)
                with torch.no_grad():
                    made = net.generate(**held, max_new_tokens=max_new_tokens, pad_token_id=words.eos_token_id, **how)
                out.append(words.decode(made[0][held["input_ids"].shape[1] :], skip_special_tokens=True).strip())
            return out

        return ask

    return make


_made: dict[str, Provider] = {}


def _provider(key: str, make: Callable[[], Provider]) -> Provider:
    """The provider of a factory, made once in a worker process, however many tasks it runs."""
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def _asked(ask: Provider, prompt: str, retries: int, back_off: float) -> tuple[str | None, str | None]:
    """(answer, error); after an error it waits, twice as long each time, and asks again."""
    for attempt in range(retries + 1):
        try:
            (found,) = ask([prompt])
            return found, None
        except Exception as e:  # one prompt's trouble, whatever it is, stays with it
            error = f"{type(e).__name__}: {e}"
        if attempt < retries:
            time.sleep(back_off * 2**attempt)
    return None, error


def answer(
    prompts: DataFrame,
    make: Callable[[], Provider] = fixed_answers,
    partitions: int | None = None,
    prompt_col: str = "prompt",
    window: int = 1,
    retries: int = 2,
    back_off: float = 1.0,
) -> DataFrame:
    """prompts with response and error: one of them is null.

    partitions bounds the tasks that ask, window the requests that a task has under way; window 1 is for providers that can't be
    called from several threads. A prompt whose request fails after all retries has an error, and fails nothing else. A null prompt counts as empty.
    """
    names = [*prompts.columns, "response", "error"]
    key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _provider(key, make)
        with ThreadPoolExecutor(max(1, window)) as pool:
            for batch in batches:
                each = pool.map if window > 1 else map
                found = list(each(lambda p: _asked(ask, p or "", retries, back_off), batch.column(prompt_col).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", response string, error string"
    return (prompts.repartition(partitions) if partitions else prompts).mapInArrow(run, fields)


def answer_stored(prompts: DataFrame, make: Callable[[], Provider], path: str, by: tuple[str, ...] = (), prompt_col: str = "prompt", wave_rows: int = WAVE_ROWS, **how) -> DataFrame:
    """answer(), by way of a table of responses at path: what stands there without an error is not asked again, equal prompts are asked once.

    by names columns that make equal prompts different questions, as the pass of a vote does. The table is committed wave by wave.
    how goes to answer().
    """
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (prompt_col, *by)]
    keyed = prompts.withColumn("__ask", F.sha2(F.concat_ws("\u0000", *parts), 256))
    wanted = keyed.select(F.col("__ask").alias("ask"), F.col(f"`{prompt_col}`").alias("prompt"))
    got = fill(wanted, "ask", path, "ask string, response string, error string", lambda some: answer(some, make, **how), wave_rows)
    return keyed.join(got, keyed["__ask"] == got["ask"], "left").drop("__ask", "ask")
