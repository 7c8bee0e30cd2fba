"""sediment.streaming"""
