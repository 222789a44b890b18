"""docloom: grounded document search, record lookup and corpus preparation as Spark plans."""
