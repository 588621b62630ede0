"""The analytic queries: ``(star, request) -> DataFrame``."""
