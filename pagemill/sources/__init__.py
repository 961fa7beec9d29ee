"""pagemill.sources"""
