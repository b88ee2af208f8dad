"""Views over the tables, registered queries and their SQL."""
