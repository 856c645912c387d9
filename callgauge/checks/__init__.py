"""Every operator as a query over the sample tables, and the same result in SQL."""
