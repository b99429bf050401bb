"""Audio envelopes on sounds whose answer is known."""

import struct
import wave

import numpy as np
import pytest
from gatelight.sources import audio

HZ = 8000


def tone(f, seconds=1.0, loud=0.5):
    return loud * np.sin(2 * np.pi * f * np.arange(int(HZ * seconds)) / HZ)


@pytest.mark.parametrize("f, kept", [(1000, 1.0), (2000, 1.0), (60, 0.0), (3900, 0.0), (300, 0.5)])
def test_the_band_passes_speech_alone(f, kept):
    x = tone(f)
    out = audio.speech_band(x, HZ)
    inner = slice(HZ // 5, -HZ // 5)
    assert len(out) == len(x)
    assert np.sqrt(np.mean(out[inner] ** 2) / np.mean(x[inner] ** 2)) == pytest.approx(kept, abs=0.03)


def test_step_by_step_sums():
    rng = np.random.default_rng(2)
    x, fps = rng.normal(0, 0.1, HZ), 10
    found = audio.features(x, HZ, fps)
    hop, size = 800, 1600
    want = [np.sqrt(np.mean(x[k * hop : k * hop + size] ** 2)) for k in range((len(x) - size) // hop + 1)]
    energy = (np.clip(20 * np.log10(want), -60, 0) + 60) / 60
    assert found["energy"].to_numpy() == pytest.approx(audio.smoothed(energy, 3)) and list(found["t"]) == pytest.approx([k / 10 for k in range(len(want))])


def test_speech_stands_out_from_hum_and_silence():
    voice = tone(400, 2, 0.3) * (1 + 0.5 * np.sin(2 * np.pi * 4 * np.arange(2 * HZ) / HZ))
    found = audio.features(np.concatenate([np.zeros(2 * HZ), voice, np.zeros(2 * HZ)]), HZ, 10)
    at = lambda a, b: found[(found.t >= a) & (found.t < b)]["speech"].mean()
    assert at(2.4, 3.4) > 0.6 and at(0.2, 1.5) < 0.05 and at(4.6, 5.6) < 0.05
    assert len(audio.features(np.zeros(100), HZ, 10)) == 0


def test_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, HZ, 0, "NONE", ""))
        w.writeframes(b"".join(struct.pack("<h", int(20000 * v)) for v in tone(700, 1.5)))
    rows = audio.audio_features(spark, str(tmp_path), 10).orderBy("i").collect()
    assert [r.i for r in rows] == list(range(14)) and all(0 <= r.speech <= 1 and 0.5 < r.energy <= 1 for r in rows[2:-2])
