"""sediment.plans"""
