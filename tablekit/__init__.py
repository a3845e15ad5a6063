"""tablekit: data-science operators over wide tables, as Spark DataFrame code."""
