"""Views, registered queries and session helpers."""
