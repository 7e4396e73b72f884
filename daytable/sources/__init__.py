"""Reading delimited text, writing tables, and the small tables that go with them."""
