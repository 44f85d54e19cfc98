"""Word lists, themes, genres and section families that results depend on.

They are data: every operator takes its lists as an argument and these are the defaults.
"""

from __future__ import annotations

from typing import NamedTuple


class Theme(NamedTuple):
    id: str
    label: str
    phrases: tuple[str, ...]


TAXONOMY_VERSION = "1.0.0-keyword-baseline"

# The twelve themes, in order, and the phrases that give evidence of each.
THEMES = (
    Theme("customers_and_service", "Customers and service", ("customer", "customers", "customer experience", "client", "clients", "consumer", "consumers", "patient", "patients", "service")),
    Theme("employees_and_workplace", "Employees and workplace", ("employee", "employees", "our people", "workforce", "talent", "workplace", "professional development", "career development")),
    Theme("innovation_and_excellence", "Innovation and excellence", ("innovation", "innovative", "invent", "excellence", "quality", "continuous improvement", "best in class")),
    Theme("integrity_and_ethics", "Integrity and ethics", ("integrity", "ethical", "ethics", "honesty", "honest", "trust", "transparent", "transparency")),
    Theme("diversity_equity_and_inclusion", "Diversity, equity, and inclusion", ("diversity", "diverse", "equity", "inclusion", "inclusive", "belonging", "equal opportunity")),
    Theme("social_impact_and_community", "Social impact and community", ("community", "communities", "social impact", "society", "philanthropy", "volunteer", "giving back")),
    Theme("environment_and_sustainability", "Environment and sustainability", ("sustainability", "sustainable", "environment", "environmental", "climate", "emissions", "renewable", "natural resources")),
    Theme("health_safety_and_wellbeing", "Health, safety, and wellbeing", ("health", "healthy", "safety", "safe", "wellbeing", "well-being", "security")),
    Theme("shareholders_and_performance", "Shareholders and performance", ("shareholder", "shareholders", "shareholder value", "financial performance", "profitable growth", "long-term value", "returns")),
    Theme("leadership_and_accountability", "Leadership and accountability", ("leadership", "leader", "leaders", "accountability", "accountable", "ownership", "responsibility", "responsible")),
    Theme("collaboration_and_partnership", "Collaboration and partnership", ("collaboration", "collaborate", "teamwork", "partnership", "partnerships", "together")),
    Theme("purpose_and_identity", "Purpose and identity", ("our purpose", "our mission", "our values", "core values", "who we are", "we exist to", "our vision")),
)

# Words of each linguistic indicator.
LEXICONS = {
    "first_person_plural": ("we", "our", "ours", "us"),
    "commitment": ("will", "must", "commit", "committed", "promise", "pledge"),
    "aspiration": ("aim", "aims", "aspire", "seek", "strive", "hope", "vision"),
    "action_or_evidence": ("achieved", "delivered", "launched", "reduced", "increased", "invest", "invested", "created", "implemented"),
    "stakeholder": ("customer", "customers", "employee", "employees", "community", "communities", "supplier", "suppliers", "shareholder", "shareholders", "partner", "partners"),
}

# Phrases of the three proxy genres.
GENRES = {
    "shareholder_mechanics": ("annual meeting", "special meeting", "proxy card", "record date", "beneficial owner", "street name", "broker non-vote", "quorum", "vote", "voting", "proposal", "proposals", "stockholder proposal", "shareholder proposal", "proxy statement"),
    "governance_boilerplate": ("board", "board of directors", "committee", "audit committee", "compensation committee", "nominating", "corporate governance", "director", "directors", "independence", "independent director", "executive compensation", "compensation"),
    "legal_procedural": ("pursuant", "in accordance", "regulation", "securities", "exchange act", "sec", "filing", "solicitation", "hereby", "applicable law", "rules and regulations", "safe harbor"),
}

# Phrases of each section family; the first family that fits counts.
SECTION_FAMILIES = {
    "meeting_voting": ("annual meeting", "information about the meeting", "voting", "vote", "proxy", "quorum", "record date"),
    "governance_board": ("corporate governance", "board of directors", "director nominees", "board", "committees", "committee", "independence"),
    "compensation": ("compensation discussion", "executive compensation", "compensation committee", "pay ratio", "incentive plan", "summary compensation"),
    "shareholder_proposals": ("shareholder proposal", "stockholder proposal", "proposal", "proposals"),
    "ownership": ("security ownership", "beneficial ownership", "principal shareholders", "stock ownership"),
    "audit": ("audit committee", "independent registered public accounting firm", "ratification", "auditor"),
    "human_capital_values": ("human capital", "employees", "diversity", "inclusion", "sustainability", "environment", "community", "culture", "values", "workforce"),
    "legal_other": ("section 16", "securities exchange act", "other matters", "solicitation", "forward-looking"),
}

# Event windows and their years.
EVENT_WINDOWS = {"pre_2020": (2016, 2017, 2018, 2019), "covid_dei_governance_window": (2020, 2021), "post_2021": (2022, 2023, 2024)}

# A taxonomy of words that are frequent in the sample texts, where the themes above have no match.
CORPUS_THEMES = (
    Theme("article", "Articles", ("the", "a", "la", "der")),
    Theme("relation", "Relations", ("of", "in the", "of the", "de")),
    Theme("copula", "Copulas", ("is", "was", "be", "est")),
    Theme("joining", "Joining words", ("and", "with", "et", "und")),
)
CORPUS_LEXICONS = {"first": ("the", "a"), "second": ("of", "in", "on"), "third": ("is", "was", "be")}
