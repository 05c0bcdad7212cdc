"""Column expressions for units and plasma quantities; null where the inputs are out of domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Physical constants (cgs and eV unless the name says otherwise).
EV_TO_K = 11604.518
KEV_ANGSTROM = 12.39841984
CM_PER_ANGSTROM = 1.0e-8
CM_PER_NM = 1.0e-7
HBAR_EV_S = 6.582119569e-16
CHARGE_C = 1.602176634e-19
ELECTRON_KG = 9.1093837015e-31
HBAR_J_S = 1.054571817e-34
BOHR_M = 5.29177210903e-11
LIGHT_CM_S = 2.99792458e10
THOMSON_CM2 = 6.6524587321e-25

#: Display factor by field family.
DISPLAY = {
    "length": ("um", 1.0e4),
    "time": ("ns", 1.0e9),
    "velocity": ("km/s", 1.0e-5),
    "pressure": ("GPa", 1.0e-3),
    "density": ("g/cm3", 1.0),
    "temperature": ("eV", 1.0),
    "number_density": ("1/cm3", 1.0),
    "specific_energy": ("MJ/kg", 1.0e-3),
    "power_density": ("W/g", 1.0),
    "mass": ("mg", 1.0e3),
}


def positive(x: Column, value: Column) -> Column:
    """``value`` where ``x`` is positive."""
    return F.when(x > 0, value)


def to_display(x: Column, family: Column) -> Column:
    """Scales a value by its family's factor; an unknown family leaves it unchanged."""
    factors = F.create_map(*[F.lit(v) for k, (_, f) in DISPLAY.items() for v in (k, f)])
    return x * F.coalesce(factors[family], F.lit(1.0))


def kelvin(te_ev: Column) -> Column:
    return te_ev * EV_TO_K


def wavelength_cm(energy_kev: Column) -> Column:
    return positive(energy_kev, F.lit(KEV_ANGSTROM * CM_PER_ANGSTROM) / energy_kev)


def energy_ev(wavelength_nm: Column) -> Column:
    return positive(wavelength_nm, F.lit(1000.0 * KEV_ANGSTROM) / (wavelength_nm * 10.0))


def shift_to_energy_ev(shift_nm: Column, line_nm: Column) -> Column:
    return -shift_nm * energy_ev(line_nm) / line_nm


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log10(1.0 + F.abs(x))


def signed_log_inverse(y: Column) -> Column:
    return F.signum(y) * (F.pow(F.lit(10.0), F.abs(y)) - 1.0)


def kinetic_energy(v: Column) -> Column:
    """Specific kinetic energy, J/g from cm/s."""
    return 0.5 * v * v * 1.0e-7


def debye_cm(te: Column, ne: Column) -> Column:
    return F.when((te > 0) & (ne > 0), 7.43e2 * F.sqrt(te / ne))


def plasma_frequency(ne: Column) -> Column:
    return positive(ne, 5.64e4 * F.sqrt(ne))


def plasma_energy_ev(ne: Column) -> Column:
    return HBAR_EV_S * plasma_frequency(ne)


def coulomb_log(te: Column, ne: Column, z: Column) -> Column:
    least = F.greatest(1.44e-7 * F.greatest(z, F.lit(1.0e-6)) / te, 2.76e-8 / F.sqrt(te))
    return F.when((te > 0) & (ne > 0), F.when(debye_cm(te, ne) > least, F.log(debye_cm(te, ne) / least)))


def coulomb_log_piecewise(te: Column, ne: Column, z: Column) -> Column:
    zv = F.greatest(z, F.lit(1.0))
    cold = 23.0 - F.log(F.sqrt(ne) * zv * F.pow(te, F.lit(-1.5)))
    hot = 24.0 - F.log(F.sqrt(ne) / te)
    value = F.when(te < 10.0 * zv * zv, cold).otherwise(hot)
    return F.when((te > 0) & (ne > 0), F.when(value > 0, value))


def collision_rate(ne: Column, te: Column, log_: Column) -> Column:
    return F.when((ne > 0) & (te > 0) & (log_ > 0), 2.91e-6 * ne * log_ * F.pow(te, F.lit(-1.5)))


def sound_speed(te: Column, z: Column, mass: Column, gamma: float) -> Column:
    return F.when((te > 0) & (z > 0) & (mass > 0), 9.79e5 * F.sqrt(gamma * z * te / mass))


def wavevector_cm(energy_kev: Column, angle_deg: Column) -> Column:
    return F.lit(4.0) * F.pi() * F.sin(F.radians(angle_deg) / 2.0) / wavelength_cm(energy_kev)


def thermal_speed_m_s(te: Column) -> Column:
    return positive(te, F.sqrt(te * CHARGE_C / ELECTRON_KG))


def fermi_wavevector_m(ne: Column) -> Column:
    return positive(ne, F.pow(3.0 * F.pi() * F.pi() * ne * 1.0e6, F.lit(1.0 / 3.0)))


def fermi_energy_ev(ne: Column) -> Column:
    k = fermi_wavevector_m(ne)
    return k * k * (HBAR_J_S * HBAR_J_S / (2.0 * ELECTRON_KG) / CHARGE_C)


def degeneracy(te: Column, ne: Column) -> Column:
    return te / fermi_energy_ev(ne)


def wigner_seitz(ne: Column) -> Column:
    return positive(ne, F.pow(3.0 / (4.0 * F.pi() * ne * 1.0e6), F.lit(1.0 / 3.0)) / BOHR_M)


def bohm_gross_peak_ev(ne: Column, k_debye: Column, gamma: float = 3.0) -> Column:
    """Quick-look plasmon peak."""
    return F.sqrt(1.0 + gamma * k_debye * k_debye) * plasma_energy_ev(ne)


def collectivity(k_debye: Column) -> Column:
    """Regime of a scattering measurement by k times the Debye length; what is unknown is not collective."""
    return F.when(k_debye < 1.0, "collective").otherwise("non-collective")


def dense_floor(rate: Column, ne: Column, fraction: float = 0.05) -> Column:
    """A collision rate no lower than a fraction of the plasma frequency."""
    return F.greatest(F.coalesce(rate, F.lit(0.0)), fraction * plasma_frequency(ne))


def free_free_per_m(te: Column, ne: Column, z: Column, energy_kev: Column) -> Column:
    """Inverse-bremsstrahlung coefficient; infinite at or under the plasma cutoff."""
    log_ = coulomb_log(te, ne, F.greatest(z, F.lit(1.0)))
    omega = energy_kev * 1.0e3 / HBAR_EV_S
    cut = 1.0 - F.pow(plasma_frequency(ne) / omega, F.lit(2.0))
    ne_m = ne * 1.0e6
    alpha = 3.1e-17 * z * ne_m * ne_m * log_ * F.pow(te, F.lit(-1.5)) * F.pow(omega, F.lit(-2.0)) * F.pow(F.greatest(cut, F.lit(1e-300)), F.lit(-0.5))
    ok = (te > 0) & (ne > 0) & (z > 0) & (energy_kev > 0) & (log_ > 0)
    return F.when(ok, F.when(cut <= 0, F.lit(float("inf"))).otherwise(alpha))


#: Temperatures (eV) and density ratios at which a zone is plasma-like or fit for a cold table.
REGIME = {
    "plasma_te": 25.0,
    "plasma_ratio": 0.55,
    "plasma_mid_te": 15.0,
    "plasma_mid_ratio": 0.75,
    "cold_te": 12.0,
    "cold_ratio": 0.72,
    "cold_mid_te": 18.0,
    "cold_mid_ratio": 0.55,
}
#: Fixed value: the least optical depth that counts.
NEGLIGIBLE_TAU = 1.0e-8


def zone_regime(te: Column, ratio: Column, resolved: Column, t: dict[str, float] = REGIME) -> Column:
    """Plasma-like, cold-table-like or fallback by temperature and density ratio; plasma goes before cold."""
    plasma = (te >= t["plasma_te"]) | (ratio <= t["plasma_ratio"]) | ((te >= t["plasma_mid_te"]) & (ratio <= t["plasma_mid_ratio"]))
    cold = resolved & (((te <= t["cold_te"]) & (ratio >= t["cold_ratio"])) | ((te <= t["cold_mid_te"]) & (ratio >= t["cold_mid_ratio"])))
    return F.when(F.coalesce(plasma, F.lit(False)), "plasma").when(F.coalesce(cold, F.lit(False)), "cold").otherwise("fallback")


def density_ratio(rho: Column, initial: Column, first: Column) -> Column:
    reference = F.coalesce(positive(initial, initial), positive(first, first), F.lit(1.0))
    return rho / reference


def bragg_sine(energy_kev: float, d_angstrom: float) -> float:
    return KEV_ANGSTROM / energy_kev / (2.0 * d_angstrom)


def compressed_bragg_deg(compression: Column, sine: float) -> Column:
    """Angle after compression, where its sine does not exceed one."""
    s = sine * F.pow(compression, F.lit(1.0 / 3.0))
    return F.when((compression > 0) & (s <= 1.0), F.degrees(F.asin(s)))


def los_velocity(v: Column, cosine: float) -> Column:
    return v * cosine


def doppler_shift_nm(v: Column, line_nm: float) -> Column:
    return v * (line_nm / LIGHT_CM_S)


def doppler_width_nm(ti: Column, mass: float, line_nm: float) -> Column:
    return positive(ti, 7.7e-5 * line_nm * F.sqrt(ti / mass))


def loss(re: Column, im: Column) -> Column:
    """Minus the imaginary part of the reciprocal dielectric function."""
    return F.try_divide(im, re * re + im * im)


def detailed_balance(energy: Column, te: Column) -> Column:
    """-expm1(-E/T), by its series where the argument is small."""
    x = energy / te
    return F.when(F.abs(x) < 1e-6, x - 0.5 * x * x).otherwise(-F.expm1(-x))


def form_factor(q: Column, coefficients: Column) -> Column:
    """Sum of a * exp(-b s^2) over an array of (a, b), s = q / 4 pi."""
    s2 = F.pow(q / (4.0 * F.pi()), F.lit(2.0))
    return F.aggregate(coefficients, F.lit(0.0), lambda acc, c: acc + c["a"] * F.exp(-c["b"] * s2))


def upstream_zone(interface: Column, direction: Column, zones: Column) -> Column:
    low = F.greatest(F.lit(0), F.least(interface, zones - 1))
    high = F.greatest(F.lit(0), F.least(interface + 1, zones - 1))
    return F.when(direction == "low_to_high", high).otherwise(low)


def downstream_zone(interface: Column, direction: Column, zones: Column) -> Column:
    low = F.greatest(F.lit(0), F.least(interface, zones - 1))
    high = F.greatest(F.lit(0), F.least(interface + 1, zones - 1))
    return F.when(direction == "low_to_high", low).otherwise(high)


def number_token(x: Column) -> Column:
    """A number whose exponent is written with D or without a letter, as a double."""
    fixed = F.regexp_replace(F.regexp_replace(x, "[dD]", "E"), r"([0-9]\.[0-9]*)([+-][0-9]{2,3})$", "$1E$2")
    plain = F.when(~F.right(x, F.lit(1)).isin("d", "D"), x.try_cast("double"))  # most need no repair
    return F.coalesce(plain, fixed.try_cast("double"))


def resolved_formula(explicit: Column, eos: Column, opacity: Column, *names: Column) -> Column:
    """A material's formula: the stated one, else that of its equation of state, of its opacity table, of its model names; blanks count as missing."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (explicit, eos, opacity, *names)])


def canonical_name(label: Column, aliases: dict[str, str]) -> Column:
    snake = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    if not aliases:
        return snake
    return F.coalesce(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[snake], snake)
