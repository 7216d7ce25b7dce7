"""The job portal a table was captured from: everything site-specific an operator takes as a parameter."""

from __future__ import annotations

from dataclasses import dataclass

# ---- fixed values: path names of the captured pages ---------------------------------------------
RESERVED_COMPANIES = (
    "home", "pricing", "integrations", "registration", "sign_in", "profile", "autocomplete", "job_offers",
)
FORBIDDEN_PARAMS = ("sort_by", "locale")
PREFIXES = {"job": "job_offers", "company": "companies"}


@dataclass(frozen=True)
class Portal:
    """`base_url` is what links are built on; `hosts` are the names a pasted link may carry."""

    base_url: str = "https://jobs.example.com"
    hosts: tuple[str, ...] = ("jobs.example.com", "www.jobs.example.com")
    reserved: tuple[str, ...] = RESERVED_COMPANIES

    @property
    def host(self) -> str:
        return self.base_url.split("://", 1)[1]


DEFAULT = Portal()
