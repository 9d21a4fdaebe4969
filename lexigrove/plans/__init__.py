"""The catalogue of queries and the SQL that checks them."""
