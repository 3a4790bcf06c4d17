"""Scalar functions of signals as Column expressions: complex numbers as (re, im) columns, logs, masks, geometry, acoustics.

All stay in whole-stage code generation. The speed of sound is a parameter everywhere (343 m/s by default)."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest step of 32-bit floats at 1, the floor of logs and divisions.
EPSILON = 1.1920929e-07
SPEED = 343.0


class Complex(NamedTuple):
    """A complex number of two double columns."""

    re: Column
    im: Column

    def __add__(self, o):
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o):
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def conj(self):
        return Complex(self.re, -self.im)

    def scaled(self, k):
        return Complex(self.re * k, self.im * k)

    def power(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.power())

    def angle(self) -> Column:
        return F.atan2(self.im, self.re)

    def divided(self, o: Complex, floor: float = 0.0) -> Complex:
        """self / o; floor is added to the squared magnitude of o."""
        d = o.power() + F.lit(floor)
        return Complex((self.re * o.re + self.im * o.im) / d, (self.im * o.re - self.re * o.im) / d)


def at(prefix: str = "", suffix: str = "") -> Complex:
    """The number in columns <prefix>re<suffix> and <prefix>im<suffix>."""
    return Complex(F.col(f"{prefix}re{suffix}"), F.col(f"{prefix}im{suffix}"))


def polar(magnitude: Column, angle: Column) -> Complex:
    return Complex(magnitude * F.cos(angle), magnitude * F.sin(angle))


def cis(angle: Column) -> Complex:
    return Complex(F.cos(angle), F.sin(angle))


def floored_log(x: Column, eps: float = EPSILON) -> Column:
    return F.ln(F.greatest(x, F.lit(eps)))


def decibel(power: Column, floor: float = 1e-5) -> Column:
    return 10 * F.log10(power + F.lit(floor))


def sigmoid(x: Column, a: float = 1.0, b: float = 0.0) -> Column:
    """1 / (1 + exp(-a (x - b))), by the branch that can't overflow."""
    z = F.lit(a) * (x - F.lit(b))
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def compressed(x: Column, k: float = 10.0, c: float = 0.1) -> Column:
    """k (1 - exp(-c x)) / (1 + exp(-c x)): values in (-k, k)."""
    e = F.exp(F.lit(-c) * F.abs(x))
    return F.signum(x) * k * (1 - e) / (1 + e)


def wrapped(phase: Column) -> Column:
    """Phase in [-pi, pi)."""
    y = phase + math.pi
    return y - F.floor(y / (2 * math.pi)) * (2 * math.pi) - math.pi


def next_power(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(n))).cast("long")


def file_key(path: Column) -> Column:
    """Name of a file without folder and last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def numbers(text: Column) -> Column:
    """"a,b,c" as an array of doubles."""
    return F.transform(F.split(text, ","), lambda x: F.btrim(x).cast("double"))


def pairs(text: Column) -> Column:
    """"i,j;k,l" as an array of (i, j)."""
    part = lambda p, k: F.btrim(F.element_at(F.split(p, ","), k)).cast("int")
    return F.transform(F.split(text, ";"), lambda p: F.struct(part(p, 1).alias("i"), part(p, 2).alias("j")))


def snr_gain(signal: Column, reference: Column, snr: Column, eps: float = EPSILON) -> Column:
    """Factor that brings a signal of this power to `snr` dB below the reference's power."""
    return F.sqrt(reference / (signal * F.pow(F.lit(10.0), snr / 10) + F.lit(eps)))


def sinc(x: Column, normalized: bool = True) -> Column:
    y = x * math.pi if normalized else x
    return F.when(y == 0, 1.0).otherwise(F.sin(y) / y)


def window_value(n: Column, size: int, kind: str = "hann", periodic: bool = True) -> Column:
    """Analysis window at sample n."""
    turn = 2 * math.pi / (size if periodic else size - 1)
    c1, c2 = F.cos(n * turn), F.cos(n * (2 * turn))
    hann = 0.5 - 0.5 * c1
    return {"hann": hann, "sqrthann": F.sqrt(F.greatest(hann, F.lit(0.0))), "hamming": 0.54 - 0.46 * c1, "blackman": 0.42 - 0.5 * c1 + 0.08 * c2, "rectangular": F.lit(1.0)}[kind]


def linear_delay(doa_degrees: Column, position: Column, speed: float = SPEED) -> Column:
    """Seconds by which a plane wave reaches a microphone of a linear array late."""
    return F.cos(F.radians(doa_degrees)) * position / speed


def circular_delay(doa_degrees: Column, mic: Column, around: int, radius: float, speed: float = SPEED) -> Column:
    return -F.cos(F.radians(doa_degrees) - mic * (2 * math.pi / around)) * radius / speed


def omega(f: Column, bins: int, sr: int) -> Column:
    return f * (math.pi * sr / (bins - 1))


#: Directivity rho of a microphone, rho + (1 - rho) * cosine towards the source.
PATTERNS = {"omnidirectional": 1.0, "subcardioid": 0.75, "cardioid": 0.5, "hypercardioid": 0.25, "bidirectional": 0.0}


def directivity(x: Column, y: Column, z: Column, pattern: str, azimuth: float = 0.0, elevation: float = 0.0) -> Column:
    """Gain of a microphone that looks at (azimuth, elevation) for a source in direction (x, y, z)."""
    rho = PATTERNS[pattern]
    if rho == 1.0:
        return F.lit(1.0)
    length = F.sqrt(x * x + y * y + z * z)
    towards = (x * (math.cos(azimuth) * math.cos(elevation)) + y * (math.sin(azimuth) * math.cos(elevation)) + z * math.sin(elevation)) / length
    return rho + (1 - rho) * towards


def milliseconds(ms: Column, sr: int) -> Column:
    return (ms * sr / 1000).cast("long")


def sabine_rt60(x: Column, y: Column, z: Column, absorption: Column, speed: float = SPEED, least: float = 0.128) -> Column:
    """Reverberation time of a shoebox room with one absorption coefficient."""
    volume, surface = x * y * z, 2 * (x * y + x * z + y * z)
    return F.greatest(24 * math.log(10) * volume / (speed * surface * absorption), F.lit(least))


def absorption_for(x: Column, y: Column, z: Column, rt60: Column, speed: float = SPEED) -> Column:
    return 24 * math.log(10) * (x * y * z) / (speed * 2 * (x * y + x * z + y * z) * rt60)


def valid_doa(doa: Column, geometry: str) -> Column:
    """Linear arrays tell 0 to 180 degrees apart, circular ones 0 to below 360."""
    return (doa >= 0) & (doa <= 180) if geometry == "linear" else (doa >= 0) & (doa < 360)
