"""Settings of the venue and menu operators, and their fixed word lists."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Generic words that don't tell venues apart.
STOP_WORDS = tuple(
    """restaurant restaurante pizzeria pizzería bar cafe café tavern taberna grill parrilla bistro canteen cafeteria
    cafetería pizza sushi burger kebab taco pasta curry wok kebap doner döner ltd inc corp llc co limited corporation
    plc gmbh sarl sa ag sas sl s.l. s.l the la el los las del de en un una al por con y e i a o lo food comida house
    casa home hogar express expresso fast rapido rápido club service servicio shop tienda store place lugar point
    punto center centro""".split()
)
# Legal forms, of which one is dropped from the end of a name.
LEGAL_SUFFIXES = tuple("ltd inc corp llc co limited corporation plc gmbh sarl sa ag sas agency".split())
# Words of addresses that don't tell streets apart, besides STOP_WORDS.
STREET_WORDS = tuple("calle carrer street ronda avenue av avda camino plaza passeig paseo via vía carretera c cr cl de del la el los las lo en al san santa sant".split())
# Known cities; the first in this order wins.
CITIES = (
    "Barcelona", "Madrid", "Valencia", "Seville", "Bilbao", "Malaga", "Zaragoza", "Palma", "Las Palmas", "Alicante",
    "Murcia", "Granada", "Vigo", "Gijon", "Hospitalet de Llobregat", "London", "Paris", "Berlin", "Rome", "Milan",
    "Lisbon", "Porto", "Amsterdam", "Brussels", "Vienna", "Dublin", "Manchester", "Birmingham", "Liverpool",
    "Glasgow", "Edinburgh",
)
# Dish words and the category that each stands for.
ALIASES = {
    "pollo": "chicken", "cerveza": "beer", "hamburguesa": "burger", "queso": "cheese", "ensalada": "salads",
    "patatas": "fries", "patata": "fries", "atún": "tuna", "atun": "tuna", "zumo": "juice", "ternera": "beef",
    "bocadillo": "sandwich", "refresco": "soft drinks", "cola": "soft drinks", "coca": "soft drinks",
    "fanta": "soft drinks", "naranja": "fruit", "limón": "fruit", "limon": "fruit", "alitas": "chicken",
    "costillas": "pork", "cerdo": "pork", "conejo": "rabbit", "salsa": "sauces", "arroz": "paella", "fruta": "fruit",
    "legumbres": "legumes", "helado": "ice cream", "pizza": "pizza", "sopa": "vegetable soups and creams",
    "crema": "vegetable soups and creams", "verduras": "vegetable soups and creams",
}
# Section titles of menus.
SECTION_TITLES = (
    "PIZZES", "PIZZAS", "BURGERS", "ENTREPANS", "AMANIDES", "PASTES", "DOLÇOS", "SALSES", "TOPPINGS", "LES CASSOLETES",
    "COSETES BONES", "POSTRES", "BEBIDAS", "ENTRANTS", "ENTRANTES", "SEGONS", "SEGUNDOS", "PLATES", "COMBINADOS",
    "ESPECIALITAT", "DRINKS", "CURRIES",
)
# Parts of words that speak for a menu when an image's orientation is chosen.
MENU_HINTS = ("pizz", "burg", "preu", "salsa", "amb", "formatge", "de")


def _from_env(name: str, kind: type, default):
    """An environment variable as int, float or comma-separated list; the default if unset or malformed."""
    raw = os.environ.get(name)
    if raw is None:
        return default
    if kind is list:
        return [x.strip() for x in raw.split(",") if x.strip()] or default
    try:
        return kind(raw)
    except ValueError:
        return default


@dataclass(frozen=True)
class Settings:
    """Thresholds and weights; every operator takes them as one object."""

    weight_name: float = 0.6
    weight_geo: float = 0.4
    lambda_geo: float = 0.00035
    match_threshold: float = 0.70
    cell: float = 0.05
    band: float = 0.02
    name_shortcut: float = 0.70
    strong_address: float = 0.8
    weak_address: float = 0.4
    strong_boost: float = 0.15
    weak_boost: float = 0.08
    fuzzy_word: float = 80.0
    fuzzy_word_length: int = 4
    classify_cutoff: float = 1.0
    menu_cutoff: float = 0.55
    description_cutoff: float = 60.0
    price_tolerance: float = 0.01
    ocr_confidence: float = 0.35
    cities: tuple[str, ...] = field(default=CITIES)

    def __post_init__(self) -> None:
        for name in ("weight_name", "weight_geo", "match_threshold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if abs(self.weight_name + self.weight_geo - 1) > 0.01:
            raise ValueError("weight_name and weight_geo must add up to 1")

    @classmethod
    def from_env(cls) -> Settings:
        """Defaults, with ER_WEIGHT_NAME, ER_WEIGHT_GEO, ER_LAMBDA_GEO, ER_DEFAULT_THRESHOLD and KNOWN_CITIES from the environment."""
        d = cls()
        return cls(
            weight_name=_from_env("ER_WEIGHT_NAME", float, d.weight_name),
            weight_geo=_from_env("ER_WEIGHT_GEO", float, d.weight_geo),
            lambda_geo=_from_env("ER_LAMBDA_GEO", float, d.lambda_geo),
            match_threshold=_from_env("ER_DEFAULT_THRESHOLD", float, d.match_threshold),
            cities=tuple(_from_env("KNOWN_CITIES", list, list(d.cities))),
        )
