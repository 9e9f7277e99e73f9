"""Jobs that decode recordings: headers, window features, frames, clips and scores.

Only paths and ranges are shuffled.  A recording's header tells its length; it is then split into ranges of some
seconds, and each range is read by seeking in the file inside a task, with what its last window or frame needs beyond
its end.  So a task holds one range at a time, however long the recording, and no samples are in any exchange.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.paths import open_path
from .windows import SIZE_S, STRIDE_S

FEATURES = ("rms", "peak", "low_freq_ratio", "band_fraction", "centroid_hz", "flatness", "crest", "env_cv", "onset_rate", "pulse_share", "pulse_hz", "band_log_ratio", "fm_spread_hz", "low_mod_cv")
_CATALOG = "path string, recording string, duration_s double, sample_rate int, error string"
#: Seconds of a recording that a task reads at once.
RANGE_S = 60.0
BAD = (wave.Error, EOFError, ZeroDivisionError, ValueError)


def _name(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name[:-4] if name.lower().endswith(".wav") else name


def _samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples in -1..1."""
    if width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 4:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2147483648
    else:
        raise ValueError(f"samples of {width} bytes")
    return x.reshape(-1, channels).mean(axis=1) if channels > 1 else x


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """Mono samples in -1..1 of a whole file, and their rate."""
    with wave.open(io.BytesIO(content)) as w:
        return _samples(w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels()), w.getframerate()


@contextmanager
def _opened(path: str) -> Iterator[wave.Wave_read]:
    """A recording's header, read from its store; samples follow by seeking."""
    with open_path(path) as f, wave.open(f) as w:
        yield w


def _between(w: wave.Wave_read, first: int, last: int) -> np.ndarray:
    """Samples from ``first`` up to ``last``."""
    first, last = max(0, first), min(last, w.getnframes())
    w.setpos(min(first, w.getnframes()))
    return _samples(w.readframes(max(0, last - first)), w.getsampwidth(), w.getnchannels())


def recording_catalog(files: DataFrame) -> DataFrame:
    """Length and rate of each file at ``path``, from its header alone; an unreadable one has its reason in ``error``."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for path in pdf.path:
                try:
                    with _opened(path) as w:
                        rows.append((path, _name(path), w.getnframes() / w.getframerate(), w.getframerate(), None))
                except BAD as e:
                    rows.append((path, _name(path), None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "recording", "duration_s", "sample_rate", "error"])

    return files.select("path").mapInPandas(run, _CATALOG)


def recording_ranges(files: DataFrame, range_s: float = RANGE_S) -> DataFrame:
    """``path, range_no``: the readable files at ``path`` by ranges of ``range_s`` seconds, dealt to tasks by range."""
    good = recording_catalog(files).where("error IS NULL")
    ranges = good.select("path", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration_s") / range_s) - 1, F.lit(0)).cast("int"))).alias("range_no"))
    return ranges.repartition("path", "range_no")


def _ranged(files: DataFrame, read: Callable[[wave.Wave_read, int], Iterator[pd.DataFrame]], schema: str, range_s: float) -> DataFrame:
    """What ``read`` makes of each range, with the recording's name in front; ``read`` gets the open file and the range's number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, k in zip(batch.column("path").to_pylist(), batch.column("range_no").to_pylist(), strict=True):
                with _opened(path) as w:
                    for rows in read(w, k):
                        rows.insert(0, "recording", _name(path))
                        yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return recording_ranges(files, range_s).mapInArrow(run, f"recording string, {schema}")


def window_statistics(x: np.ndarray, rate: int, low_hz: float = 1500.0, band: tuple[float, float] = (400.0, 1200.0)) -> dict[str, float]:
    """The features of one window."""
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 + 1e-20
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    total = power.sum()
    frame = max(1, int(0.02 * rate))
    env = np.sqrt((x[: len(x) // frame * frame].reshape(-1, frame) ** 2).mean(axis=1)) if len(x) >= frame else np.array([np.sqrt((x**2).mean())])
    rms, peak = float(np.sqrt((x**2).mean())), float(np.abs(x).max(initial=0))
    beat = np.abs(np.fft.rfft(env - env.mean())) ** 2
    beat_hz = np.fft.rfftfreq(len(env), 0.02)
    slow = (beat_hz > 1) & (beat_hz < 20)
    best = int(np.argmax(np.where(slow, beat, -1))) if slow.any() else 0
    inside = (hz >= band[0]) & (hz <= band[1])
    spread, varies = _frames(x, rate, band)
    return {
        "rms": rms,
        "peak": peak,
        "low_freq_ratio": float(power[hz <= low_hz].sum() / total),
        "band_fraction": float(power[(hz >= band[0]) & (hz <= band[1])].sum() / total),
        "centroid_hz": float((hz * power).sum() / total),
        "flatness": float(np.exp(np.log(power).mean()) / power.mean()),
        "crest": peak / rms if rms > 0 else 0.0,
        "env_cv": float(env.std() / env.mean()) if env.mean() > 0 else 0.0,
        "onset_rate": float((np.diff(env) > env.mean() * 0.5).sum() / (len(x) / rate)),
        "pulse_share": float(beat[best] / beat[slow].sum()) if slow.any() and beat[slow].sum() > 0 else 0.0,
        "pulse_hz": float(beat_hz[best]) if slow.any() else 0.0,
        "band_log_ratio": float(np.log10((power[inside].sum() + 1e-20) / (power[~inside].sum() + 1e-20))),
        "fm_spread_hz": spread,
        "low_mod_cv": varies,
    }


def _frames(x: np.ndarray, rate: int, band: tuple[float, float], size: int = 256) -> tuple[float, float]:
    """From a spectrogram of half-overlapping frames: the spread of the band's peak frequency over its louder frames, and how much the
    band's energy varies (deviation over mean)."""
    size = min(size, len(x))
    if size < 8:
        return 0.0, 0.0
    step = max(1, size // 2)
    at = np.arange(0, len(x) - size + 1, step)
    power = np.abs(np.fft.rfft(x[at[:, None] + np.arange(size)] * np.hanning(size), axis=1)) ** 2
    hz = np.fft.rfftfreq(size, 1 / rate)
    inside = (hz >= band[0]) & (hz <= band[1])
    if not inside.any():
        return 0.0, 0.0
    energy = power[:, inside].sum(axis=1)
    loud = energy >= np.median(energy)
    peaks = hz[inside][power[:, inside].argmax(axis=1)][loud]
    return float(peaks.std()), float(energy.std() / energy.mean()) if energy.mean() > 0 else 0.0


def window_starts(duration_s: float, size_s: float, stride_s: float) -> list[float]:
    n = max(0, int((duration_s - size_s) // stride_s)) if duration_s > size_s else 0
    starts = [i * stride_s for i in range(n + 1)]
    if duration_s > size_s and starts[-1] + size_s < duration_s:
        starts.append(duration_s - size_s)
    return starts


def _windows(w: wave.Wave_read, k: int, size_s: float, stride_s: float, range_s: float) -> Iterator[tuple[int, float, np.ndarray]]:
    """Number, start and samples of the windows that begin in range ``k``; a window may end in a later one."""
    rate = w.getframerate()
    size = int(size_s * rate)
    starts = [(i, s) for i, s in enumerate(window_starts(w.getnframes() / rate, size_s, stride_s)) if int(s // range_s) == k]
    if starts:
        base = int(starts[0][1] * rate)
        x = _between(w, base, int(starts[-1][1] * rate) + size)
        for i, s in starts:
            part = x[int(s * rate) - base : int(s * rate) - base + size]
            yield i, s, np.pad(part, (0, size - len(part)))


def window_features(files: DataFrame, size_s: float = SIZE_S, stride_s: float = STRIDE_S, range_s: float = RANGE_S) -> DataFrame:
    """``recording, win_no, start_s, end_s`` and FEATURES for every window of every readable file at ``path``."""

    def read(w: wave.Wave_read, k: int) -> Iterator[pd.DataFrame]:
        rows = [{"win_no": i, "start_s": s, "end_s": s + size_s} | window_statistics(x, w.getframerate()) for i, s, x in _windows(w, k, size_s, stride_s, range_s)]
        if rows:
            yield pd.DataFrame(rows).astype({"win_no": "int32"})

    return _ranged(files, read, "win_no int, start_s double, end_s double, " + ", ".join(f"{c} double" for c in FEATURES), range_s)


def score_windows(files: DataFrame, scorer: Callable[[np.ndarray, int], np.ndarray], classes: int, size_s: float = SIZE_S, stride_s: float = STRIDE_S, batch: int = 256, range_s: float = RANGE_S) -> DataFrame:
    """``recording, win_no, start_s, end_s, probs`` from a batch callable ``(windows, rate) -> scores``; a result of another width is an error."""

    def read(w: wave.Wave_read, k: int) -> Iterator[pd.DataFrame]:
        found = _windows(w, k, size_s, stride_s, range_s)
        while part := list(islice(found, batch)):
            p = np.asarray(scorer(np.stack([x for *_, x in part]), w.getframerate()), float)
            if p.shape != (len(part), classes):
                raise ValueError(f"expected {classes} scores a window, found {p.shape}")
            yield pd.DataFrame({"win_no": np.array([i for i, *_ in part], np.int32), "start_s": [s for _, s, _ in part], "end_s": [s + size_s for _, s, _ in part], "probs": list(p)})

    return _ranged(files, read, "win_no int, start_s double, end_s double, probs array<double>", range_s)


def energy_frames(files: DataFrame, hop: int = 128, n_fft: int | None = 1024, band: tuple[float, float] = (100.0, 1500.0), range_s: float = RANGE_S) -> DataFrame:
    """``recording, frame, energy, fps``: the energy envelope of every readable file at ``path``, a frame every ``hop`` samples.

    A frame's energy is that of its spectrum from ``band[0]`` up to below ``band[1]``, over ``n_fft`` samples around sample
    ``frame * hop`` under a Hann window, with silence beyond both ends; without ``n_fft`` it is the sum of the squares of the hop's samples
    (the last hop may be short).  Frames belong to the range in which their hop begins and take what they need of its neighbours.
    """

    def read(w: wave.Wave_read, k: int) -> Iterator[pd.DataFrame]:
        rate, n = w.getframerate(), w.getnframes()
        frames = np.arange(int(np.ceil(k * range_s * rate / hop)), int(np.ceil(min((k + 1) * range_s * rate, n + 1 if n_fft else n) / hop)))
        for at in range(0, len(frames), 4096):
            some = frames[at : at + 4096]
            side = n_fft // 2 if n_fft else 0
            first, last = some[0] * hop - side, some[-1] * hop + (n_fft - side if n_fft else hop)
            x = _between(w, int(first), int(last)).astype(float)
            x = np.pad(x, (max(0, -first), 0))
            x = np.pad(x, (0, last - first - len(x)))
            if n_fft:
                hz = np.fft.rfftfreq(n_fft, 1 / rate)
                pieces = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
                power = np.abs(np.fft.rfft(pieces * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
                energy = power[:, (hz >= band[0]) & (hz < band[1])].sum(axis=1)
            else:
                energy = (x.reshape(-1, hop) ** 2).sum(axis=1)
            yield pd.DataFrame({"frame": some.astype(np.int64), "energy": energy, "fps": rate / hop})

    return _ranged(files, read, "frame bigint, energy double, fps double", range_s)


def cut_clips(det: DataFrame, files: DataFrame, padding_s: float = 0.5) -> DataFrame:
    """``det_id, clip_start_s, clip`` (WAV bytes) for detections whose recording is among the files at ``path``.

    Detections meet paths; each task then seeks to its clips, ordered by place in the file.  Detections of one recording may
    go to several tasks.  An unreadable recording gives no clips; recording_catalog has the reason.
    """
    named = files.select("path", F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"(?i)\.wav$", "").alias("recording"))
    wanted = det.select("det_id", "recording", "start_s", "end_s").join(named, "recording").select("path", "det_id", "start_s", "end_s")
    wanted = wanted.repartition("path", F.floor(F.col("start_s") / (10 * RANGE_S))).sortWithinPartitions("path", "start_s")

    def cut(w: wave.Wave_read, start: float, end: float) -> tuple[float, bytes]:
        rate = w.getframerate()
        a = max(0.0, start - padding_s)
        part = _between(w, int(a * rate), int(min(w.getnframes() / rate, end + padding_s) * rate))
        out = io.BytesIO()
        with wave.open(out, "wb") as o:
            o.setnchannels(1)
            o.setsampwidth(2)
            o.setframerate(rate)
            o.writeframes((np.clip(part, -1, 1) * 32767).astype("<i2").tobytes())
        return a, out.getvalue()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, some in pdf.groupby("path", sort=False):
                try:
                    with _opened(path) as w:
                        for at in range(0, len(some), 64):
                            part = some.iloc[at : at + 64]
                            rows = [(i, *cut(w, s, e)) for i, s, e in zip(part.det_id, part.start_s, part.end_s, strict=True)]
                            yield pd.DataFrame(rows, columns=["det_id", "clip_start_s", "clip"])
                except BAD:
                    continue

    return wanted.mapInPandas(run, "det_id bigint, clip_start_s double, clip binary")


def annotate(det: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """Join window features to detections on recording and start."""
    return det.join(features.select("recording", "start_s", *columns), ["recording", "start_s"], "left")


def background_screen(scored: DataFrame, target: str, threshold: float) -> DataFrame:
    """Mined windows that the deployed rule would call the target: ``flag``, else ``keep``."""
    return scored.withColumn("screen", F.when((F.col("species") == target) & (F.col("confidence") >= threshold), "flag").otherwise("keep"))
