"""Training-data operators: ten corpus jobs and the queries that apply them."""
