"""Column functions: text, money, URLs and decisions. All of them stay inside the JVM unless their name ends in `_udf`."""
