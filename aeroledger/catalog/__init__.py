"""Every operator as a named query over the test tables, and the SQL it must agree with."""
