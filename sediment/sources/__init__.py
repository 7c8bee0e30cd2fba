"""sediment.sources"""
