"""Whole queries: the geocoder, the fixtures and the catalogue of registered queries."""
